"""Column functions on probabilities and on ordered arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest mass of a parent state, and smallest weight in priors and naive Bayes.
FLOOR = 0.001


def bound(value: Column, body) -> Column:
    """body(value), with the value worked out once a row, however often body and its lambdas name it."""
    return F.transform(F.array(value), body)[0]


def runs(rows: Column, of) -> Column:
    """The stretches of an array in which of(row) stays the same, in order; on sorted rows, the groups by it. None of null."""

    def told(a):
        changes = lambda i: (i == 0) | ~of(F.get(a, i)).eqNullSafe(of(F.get(a, i - 1)))
        starts = F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), changes)).otherwise(F.array().cast("array<int>"))
        return bound(starts, lambda s: F.transform(s, lambda x, k: F.slice(a, x + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - x)))

    return bound(rows, told)


def rounded(x: Column, places: int) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: the same operations in any engine, unlike its round()."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def total(a: Column) -> Column:
    """The sum of an array of doubles, from the left."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def uniform(n: Column) -> Column:
    """1/n, to 6 places, n times. The places' residue stays, so three states sum to 0.999999."""
    return F.array_repeat(rounded(F.lit(1.0) / n, 6), n)


def with_residue(a: Column) -> Column:
    """What is missing to 1, to 6 places, goes to the first maximum."""

    def told(a):
        fix = F.struct(rounded(F.lit(1.0) - total(a), 6).alias("rest"), F.array_position(a, F.array_max(a)).alias("at"))
        return bound(fix, lambda f: F.transform(a, lambda x, i: F.when(i + 1 == f["at"], rounded(x + f["rest"], 6)).otherwise(x)))

    return bound(a, told)


def shares(a: Column) -> Column:
    """Each value over the sum, to 6 places."""
    return bound(a, lambda a: bound(total(a), lambda s: F.transform(a, lambda x: rounded(x / s, 6))))


def conditional_row(joint: Column) -> Column:
    """P(child | parent state) from the joint's row, child states in order.

    A row with less mass than FLOOR is uniform. Negative cells count as 0 but not in the mass; rows that
    drift from 1 by more than 0.001 are shared again.
    """

    def told(joint, mass):
        plain = F.transform(joint, lambda x: rounded(F.greatest(F.lit(0.0), x) / mass, 6))
        again = bound(plain, lambda v: F.when(F.abs(total(v) - 1) > 0.001, shares(v)).otherwise(v))
        return F.when(mass < FLOOR, uniform(F.size(joint))).otherwise(with_residue(again))

    return bound(joint, lambda a: bound(total(a), lambda m: told(a, m)))


def nullable_row(joint: Column, floor: float, related: Column | bool = True) -> Column:
    """P(child | parent state) with nulls: no relation, a mass of nearly 0, or a value below the floor; to 4 places."""
    related = F.lit(related) if isinstance(related, bool) else related

    def told(joint, mass):
        keep = lambda x: related & (mass >= 1e-9) & (F.try_divide(x, mass) >= floor)
        return F.transform(joint, lambda x: F.when(keep(x), rounded(F.try_divide(x, mass), 4)))

    return bound(joint, lambda a: bound(total(a), lambda m: told(a, m)))


def prior_row(marginal: Column) -> Column:
    """The prior of a node from its marginal (null: none): floored, shared, residue to the first maximum."""
    return with_residue(shares(F.transform(marginal, lambda x: F.greatest(F.lit(FLOOR), F.coalesce(x, F.lit(FLOOR))))))


def rerooted_row(marginal: Column) -> Column:
    """As prior_row, without the residue."""
    return shares(F.transform(marginal, lambda x: F.greatest(F.lit(FLOOR), F.coalesce(x, F.lit(FLOOR)))))


def exact_row(leaf: Column) -> Column:
    """A row of a multi-parent joint: uniform below FLOOR, else shared, residue to the first maximum."""
    clipped = F.transform(leaf, lambda x: F.greatest(F.lit(0.0), x))
    return bound(clipped, lambda v: F.when(total(v) < FLOOR, uniform(F.size(v))).otherwise(with_residue(shares(v))))


def naive_bayes_row(conditionals: Column, prior: Column, exponent: int = 1) -> Column:
    """P(child | parents) from one conditional row for each parent and the child's prior.

    The product of conditionals is divided by the prior `exponent` times (the identity asks for one time
    less than there are parents; the default divides once).
    """
    floor = F.lit(FLOOR)
    p = F.transform(prior, lambda x: F.greatest(floor, F.coalesce(x, floor)))
    p = bound(p, lambda a: bound(total(a), lambda s: F.transform(a, lambda x: F.greatest(floor, x / s))))
    product = lambda c, i: F.aggregate(c, F.lit(1.0), lambda s, x: s * F.greatest(floor, F.get(x, i)))
    score = lambda c, p: F.transform(p, lambda x, i: F.greatest(floor, product(c, i) / F.pow(x, F.lit(float(exponent)))))
    return with_residue(shares(bound(conditionals, lambda c: bound(p, lambda p: score(c, p)))))


def validated_marginal(values: Column) -> Column:
    """Floored at 0.001; shared only if the sum is off by more than 0.02."""
    floored = F.transform(values, lambda x: F.greatest(F.lit(0.001), F.coalesce(x, F.lit(0.001))))
    return bound(floored, lambda v: F.when(F.abs(total(v) - 1) > 0.02, shares(v)).otherwise(v))


def kl(p: Column, q: Column, smooth: float = 1e-6) -> Column:
    """KL(p || q) in nats: both are normalised (uniform if they don't sum to more than 0), q clipped, smoothed and normalised again."""
    even = lambda a, s: F.transform(a, lambda x: F.when(s > 0, F.try_divide(x, s)).otherwise(F.lit(1.0) / F.size(a)))
    shared = lambda a: bound(a, lambda v: bound(total(v), lambda s: even(v, s)))
    clipped = F.transform(shared(q), lambda x: F.greatest(F.lit(0.0), x) + smooth)
    q1 = bound(clipped, lambda v: bound(total(v), lambda s: F.transform(v, lambda x: x / s)))
    terms = F.zip_with(shared(p), q1, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0)))
    return total(terms)


def column_kl(truth: Column, predicted: Column, rows: Column, columns: Column) -> Column:
    """The mean KL over parent states of two matrices (rows: child states), by position, to 6 places.

    Cells beyond a matrix and null cells are 0; columns stop at the smaller of `columns` and the
    predicted matrix's; null where there is no column.
    """
    width = F.least(columns, F.coalesce(F.size(F.get(predicted, 0)), F.lit(0)))
    cell = lambda m, i, j: F.coalesce(F.get(F.get(m, i), j), F.lit(0.0))
    column = lambda m, j: F.transform(F.sequence(F.lit(0), rows - 1), lambda i: cell(m, i, j))
    each = F.transform(F.sequence(F.lit(0), width - 1), lambda j: kl(column(truth, j), column(predicted, j)))
    return F.when((rows > 0) & (width > 0), rounded(total(each) / width, 6))


def precision_recall_f1(correct: Column, truth: Column, predicted: Column) -> tuple[Column, Column, Column]:
    """(f1, precision, recall) to 4 places; a zero denominator gives 0."""
    p = F.coalesce(F.try_divide(correct.cast("double"), predicted.cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(correct.cast("double"), truth.cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rounded(f1, 4), rounded(p, 4), rounded(r, 4)


def strength(p: Column) -> Column:
    """strong, moderate, weak or rare; unknown for null."""
    return F.when(p.isNull(), "unknown").when(p >= 0.70, "strong").when(p >= 0.40, "moderate").when(p >= 0.10, "weak").otherwise("rare")


def combinations(states: Column) -> Column:
    """All combinations of one state from each of several ordered lists, the last list fastest."""
    empty = F.array(F.array().cast("array<string>"))
    return F.aggregate(states, empty, lambda acc, ss: F.flatten(F.transform(acc, lambda a: F.transform(ss, lambda s: F.array_append(a, s)))))


def combination_count(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda s, n: s * n)


def joint_budget(edges: Column, states: int = 4) -> Column:
    """Reply tokens for joints of so many edges."""
    return F.least(F.lit(8000), F.greatest(F.lit(2000), edges * (40 * states * states)))


def greedy_chunks(costs: Column, budget: int) -> Column:
    """The chunk of each cost in order: a chunk is closed when it isn't empty and the next cost would pass the budget."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc, cost):
        cost = cost.cast("long")
        over = (acc["used"] > 0) & (acc["used"] + cost > budget)
        chunk = acc["chunk"] + F.when(over, 1).otherwise(0)
        return F.struct(F.when(over, cost).otherwise(acc["used"] + cost).alias("used"), chunk.alias("chunk"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(costs, zero, step, lambda acc: acc["out"])
