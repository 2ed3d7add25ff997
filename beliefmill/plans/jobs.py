"""From path to path: the runs over corpus files, one function each.

Search results and articles become raw records with `networks`. Raw records (JSON lines) get their tables with `cpds`, are made short with `compact`, and meet their texts
in `final`. Each run reads files of any number and size, writes beside or over the target when all is
done, and returns how many records took which way.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import written, written_counting
from ..operators import assemble, extract, graph, network_records, prob
from ..operators.records import articles_in_range, collected_titles, last_wins, numbered
from ..sources import files


def _placed(lines: DataFrame) -> DataFrame:
    """Lines (pos, record) as records keyed by their place, parsed."""
    return network_records.parsed(lines.withColumn("bn_id", F.format_string("%d", "pos")))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def networks(found: DataFrame, articles: DataFrame, ask: extract.Ask, model: str, target: str, per_domain: int = 10, seed: int = 42, chunk_size: int = 10) -> dict[str, int]:
    """Search results to raw records: titles, articles of a fit length, extraction, until each domain has `per_domain` networks.

    found: as records.collected_titles takes it; articles (title, url, text), of a repeated title the first by url. A round asks for
    as many of a domain's next titles as it lacks networks, so a failed article is made up for by the next
    title; it ends when all domains are full or out of titles, after 3 * per_domain rounds at most. Records are
    numbered from wiki_00000 by domain and title order. With a ledger behind `ask`, a run that starts again
    asks only what it hadn't got. Returns how many articles were asked about, failed, and written.
    """
    spark = found.sparkSession
    one = articles.groupBy("title").agg(F.min(F.struct("url", F.trim("text").alias("text"))).alias("a")).select("title", "a.*")
    fit = articles_in_range(one, F.size(F.split("text", r"\s+")))
    places = found.groupBy("domain").agg(F.min("domain_pos").alias("domain_pos"))
    titles = collected_titles(found, per_domain, seed, kept=3 * per_domain)
    titles = written(titles.join(fit, "title").join(places, "domain").withColumn("bn_id", F.col("title")), "candidates")
    tried, parts = spark.createDataFrame([], "bn_id string, domain string, status string"), []
    while True:
        had = tried.groupBy("domain").agg(F.count(F.when(F.col("status") == "ok", 1)).alias("had"))
        left = titles.join(tried.select("bn_id"), "bn_id", "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("domain").orderBy("rank")))
        now = written(left.join(had, "domain", "left").where(F.col("turn") <= per_domain - F.coalesce("had", F.lit(0))).select("bn_id", "domain", "text"), "round")
        if now.isEmpty():
            break
        got = extract.extract(now.select("bn_id", "text"), ask, model, chunk_size)
        parts.append(got)
        tried = written(tried.unionByName(now.select("bn_id", "domain").join(got.outcome, "bn_id")), "tried")
    done = titles.join(tried.where("status = 'ok'").select("bn_id"), "bn_id", "left_semi")
    placed = numbered(done.withColumn("place", F.struct("domain_pos", "rank", "title")), "place", "%d", "number").withColumn("pos", F.col("number").cast("long") - 1)
    placed = written(placed.select("pos", "bn_id", F.format_string("wiki_%05d", "pos").alias("id"), "title", "domain", "url", "text"), "placed")
    if parts:
        t = SimpleNamespace(**{name: _all([getattr(p, name) for p in parts]) for name in ("nodes", "node_state", "edges", "marginal", "joint", "multi_joint")})
        made = network_records.raw_records(placed.drop("pos").withColumn("real", F.lit(1)), t).join(placed.select("bn_id", "pos"), "bn_id")
    else:
        made = spark.createDataFrame([], "pos bigint, record string")
    rows, n = written_counting(made, "raw", {"written": F.lit(True)})
    files.write_lines(rows, target)
    asked = tried.count()
    return {"asked": asked, "failed": asked - n["written"]} | n


def cpds(spark: SparkSession, source: str, target: str, svg_dir: str, strict: bool = False) -> dict[str, int]:
    """Raw records to records with cpds, cpd_issues and svg_path, and a drawing a record; statuses ok, warn, skipped.

    strict leaves out records with issues. Records that can't be worked out (no JSON, no nodes or edges, an edge
    of an unknown node) are left out and counted as skipped. A record without an id is drawn under record_ and its place.
    """
    files.existing(spark, source)
    lines = _placed(files.read_record_lines(spark, source))
    name = F.coalesce("j.id", F.format_string("record_%05d", "pos"))
    path = F.concat(F.lit(svg_dir.rstrip("/") + "/"), name, F.lit(".svg"))
    made, svgs = network_records.cpd_records(lines.withColumn("svg", path), F.col("svg"))
    kept = F.col("status").isin(["ok"] if strict else ["ok", "warn"])
    told, n = written_counting(made, "cpd-records", {"ok": F.col("status") == "ok", "warn": (F.col("status") == "warn") & kept, "skipped": ~kept})
    told = told.where(kept)
    files.write_each(svgs.withColumnRenamed("svg", "text").join(told.select("bn_id", F.col("svg").alias("path")), "bn_id"))
    files.write_lines(told, target)
    return n


def compact(spark: SparkSession, source: str, target: str, places: int = 2) -> dict[str, int]:
    """Records with tables to a corpus file of short ones, numbered bn_00001 on in the order of the lines."""
    files.existing(spark, source)
    lines = _placed(files.read_record_lines(spark, source)).withColumn("new_id", F.format_string("bn_%05d", F.col("pos") + 1))
    short = network_records.compact_records(lines.select("pos", "new_id", "record", "j"), "new_id", places)
    rows, n = written_counting(short.join(lines.select("pos", "new_id"), "new_id"), "compact", {"total": F.lit(True)})
    about = spark.range(1).select(F.lit(n["total"]).alias("total"), F.lit(source).alias("source"), F.lit(places).alias("cpd_dp"))
    files.write_corpus(rows, about, target, key="new_id", text="record")
    return n


def final(spark: SparkSession, compact: str, marginal: str, generated: str, target: str) -> dict[str, int]:
    """Short records, the raw records they come from, and their texts, to final networks in the order of the short ones.

    Of raw records with one id the last counts. A short record without a source id belongs to the raw id at its
    place, places counted by first appearance. One without a usable raw record is skipped; without a text, its text is empty.
    """
    files.existing(spark, compact, marginal, generated)
    short = files.read_corpus(spark, compact, "source_id string, title string, domain string").select(
        F.col("bn_pos").cast("long").alias("pos"), "id", F.nullif("record.source_id", F.lit("")).alias("source_id"), F.coalesce("record.title", F.lit("")).alias("title"), F.coalesce("record.domain", F.lit("")).alias("domain"))
    raw = _placed(files.read_record_lines(spark, marginal)).withColumn("source_id", F.col("j.id")).where("source_id is not null")
    first = numbered(raw.groupBy("source_id").agg(F.min("pos").alias("pos")), "pos", "%d", "number").select(F.col("source_id").alias("by_place"), (F.col("number").cast("long") - 1).alias("pos"))
    short = short.join(first, "pos", "left").withColumn("source_id", F.coalesce("source_id", "by_place")).drop("by_place")
    texts = files.read_corpus(spark, generated, "text string").select("id", F.col("record.text").alias("given"))
    own = last_wins(raw, ["source_id"], "pos").select("source_id", "record", "j")
    met = short.join(own, "source_id", "left").join(texts, "id", "left").withColumn("bn_id", F.col("id"))
    met = written(met.withColumn("generated_text", F.coalesce("given", F.lit(""))).drop("given"), "final-met")
    t = network_records.tables(met)
    related = met.where("j.nodes is not null").select("bn_id", F.explode("j.raw_scores").alias("s")).select("bn_id", "s.parent", "s.parent_state", "s.child", "s.has_relationship")
    related = related.groupBy("bn_id", "parent", "parent_state", "child").agg(F.every("has_relationship").alias("has_relationship"))
    valid = prob.validate_marginals(t.marginal, t.node_state).select("bn_id", "node", "state", "p")
    titles = met.select("bn_id", "id", "source_id", "title", "domain", F.coalesce("j.text", F.lit("")).alias("actual_text"), "generated_text", "pos")
    kept = written(graph.validate_dag(t.edges, t.nodes), "final-dag").hint("merge")  # read for levels, roots, grids and places
    made = assemble.final_records(titles, t.nodes, t.node_state, kept, valid, t.joint, related=related).drop("bn_id", "n_nodes", "n_edges")
    rows, n = written_counting(made, "final-rows", {"ok": F.lit(True)})
    sources = F.struct(F.lit(compact).alias("compact"), F.lit(marginal).alias("marginal"), F.lit(generated).alias("generated"))
    files.write_corpus(rows, spark.range(1).select(F.lit(n["ok"]).alias("total"), sources.alias("sources")), target)
    return n | {"skipped": met.count() - n["ok"]}
