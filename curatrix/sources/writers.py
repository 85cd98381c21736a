"""Sinks. Each writes a folder of files through Spark; what must be in order is sorted by range, not in one task.

rows=False writes one file instead, which an object or array fills: tasks write its fragments, which are put together on commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions import text as T
from curatrix.sources import json_object as J, lines as L


def by_doc(df: DataFrame) -> DataFrame:
    """In numeric order of pmid, which is a string."""
    return df.orderBy(F.col("pmid").try_cast("bigint"), "pmid")


def write_edges_by_doc(df: DataFrame, path: str) -> None:
    """pmid, n, relationships as a packed table with header."""
    by_doc(df).select(F.col("pmid").alias("PMID"), F.col("n").alias("Relationship_Count"), F.col("relationships").alias("Relationships")).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_edge_pieces(pieces: DataFrame, path: str) -> None:
    """pmid, piece, n, relationships as the packed table that write_edges_by_doc writes, its lines put together piece by piece."""
    whole = pieces.join(pieces.groupBy("pmid").agg(F.sum("n").alias("total")), "pmid")
    head = F.concat_ws("\t", "pmid", F.col("total").cast("string"), F.lit(""))
    L.write_lines(whole, path, "pmid", [F.col("pmid").try_cast("bigint"), F.col("piece")], head, F.col("relationships"), "PMID\tRelationship_Count\tRelationships", "; ")


def json_string(c: Column | str) -> Column:
    """A string as JSON text."""
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def entries(df: DataFrame, key: str | None, value: Column, member: str | None = None) -> DataFrame:
    """member, key, value as write_entries takes them."""
    return df.select(F.lit(member).cast("string").alias("member"), (F.col(key) if key else F.lit(None).cast("string")).alias("key"), value.alias("value"))


def write_alias_index(tables: dict[str, DataFrame], folder: str, rows: bool = True) -> None:
    """Candidates, conflicts, the unique map, official symbols and metadata, a folder of JSON rows each under its name; `candidates` and `official` are read by read_alias_index(rows=True).

    Without rows: index.json, an object with the metadata, the sorted official symbols, and the candidates of each key in its order; and,
    if there are conflicts and a unique map, conflicts.json and unique.json, objects by key.
    """
    if rows:
        for name, df in tables.items():
            df.orderBy(df.columns[0]).write.json(f"{folder}/{name}")
        return
    if "conflicts" in tables:
        own = tables["candidates"].join(tables["conflicts"].select("key"), "key", "left_semi")
        J.write_entries(entries_by_key(own), f"{folder}/conflicts.json")
    # Members stand in the file in the order that is named here; within each, partitions are in order.
    official = entries(tables["official"], None, json_string("symbol"), "official_symbols")
    whole = official.orderBy("value").unionByName(entries_by_key(tables["candidates"], "aliases"))
    if "metadata" in tables:
        whole = whole.unionByName(entries(tables["metadata"].select(F.lit("metadata").alias("name"), F.to_json(F.struct("*")).alias("json")), "name", F.col("json")))
    J.write_entries(whole, f"{folder}/index.json", members=[("official_symbols", "array"), ("aliases", "object")])
    if "unique" in tables:
        J.write_entries(entries(tables["unique"], "key", json_string("symbol")).orderBy("key"), f"{folder}/unique.json")


def entries_by_key(candidates: DataFrame, member: str | None = None) -> DataFrame:
    """The candidates of each key as an entry, in the order of keys.

    Candidates are dealt by ranges of keys before they are gathered, so that keys with many of them fall into several tasks, and what
    finds the ranges reads keys only.
    """
    n = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), candidates.sparkSession.sparkContext.defaultParallelism)
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("symbol", "sources"))))
    whole = candidates.repartitionByRange(n, "key").groupBy("key").agg(listed.alias("json"))
    return entries(whole, "key", F.col("json"), member).sortWithinPartitions("key")


def write_ensg_map(df: DataFrame, path: str, rows: bool = True) -> None:
    """symbol, ensg in the order of symbols."""
    if rows:
        df.orderBy("symbol").write.json(path)
    else:
        J.write_entries(entries(df, "symbol", json_string("ensg")).orderBy("key"), path)


def write_excluded(df: DataFrame, path: str, rows: bool = True) -> None:
    """The distinct pmids, sorted as strings."""
    ids = df.select("pmid").distinct()
    if rows:
        ids.orderBy("pmid").write.json(path)
    else:
        J.write_entries(entries(ids.orderBy("pmid"), None, json_string("pmid")), path, "array")


def block_text() -> Column:
    """The text of a document block from pmid, edges, sections and abstract."""
    line = F.array_join(F.transform("edges", lambda e: F.concat(F.lit(f"{T.REFERENCE_LABEL}: "), e["tf"], F.lit(" -> "), e["target"], F.lit(" ("), e["direction"], F.lit(")\n"))), "")
    rule = "\n---\n"
    body = F.when(F.size("sections") > 0, F.array_join(F.transform("sections", lambda s: F.concat(F.lit("["), s["label"], F.lit("]\n"), s["text"], F.lit("\n" + rule))), "")).otherwise(F.concat(F.coalesce("abstract", F.lit("Abstract not found in PubMed")), F.lit("\n" + rule)))
    return F.concat(F.lit("\nPMID: "), F.col("pmid"), F.lit("\n"), line, F.lit("\nAbstract:" + rule), body, F.lit("\n"))


def write_document_blocks(df: DataFrame, path: str) -> None:
    """Documents (pmid, abstract, sections, edges) as blocks, a line of 50 signs after each."""
    df.select(block_text().alias("value")).write.option("lineSep", "=" * 50).text(path)


def write_overrides(df: DataFrame, path: str, rows: bool = True) -> None:
    """Overrides in the order of ord."""
    if rows:
        df.write.json(path)
    else:
        J.write_entries(entries(df.orderBy("ord"), None, F.to_json(F.struct(*[c for c in df.columns if c != "ord"]))), path, "array")


def write_extractions(edges: DataFrame, docs: DataFrame, path: str, rows: bool = True) -> None:
    """Documents (pmid, error, n_items) with their edges: a JSON row for each, or an object of pmid to array, or to the error."""
    items = F.array_sort(F.collect_list(F.struct("pos", "tf", "target", "direction", "confidence", "evidence")))
    whole = docs.join(edges.groupBy("pmid").agg(items.alias("edges")), "pmid", "left")
    if rows:
        whole.write.json(path)
    else:
        array = F.coalesce(F.to_json(F.transform("edges", lambda e: e.dropFields("pos"))), F.lit("[]"))
        failed = F.coalesce(F.col("error"), F.lit("")) != ""
        J.write_entries(entries(whole, "pmid", F.when(failed, F.to_json(F.struct("error"))).otherwise(array)), path)


def write_debug(df: DataFrame, path: str, rows: bool = True) -> None:
    """The record of each document: a JSON row for each, in the field d, or an object of pmid to record."""
    record = F.struct(*[c for c in df.columns if c != "pmid"])
    if rows:
        df.select("pmid", record.alias("d")).write.json(path)
    else:
        J.write_entries(entries(df, "pmid", F.to_json(record)), path)


def write_anomalies(df: DataFrame, path: str, mode: str = "append") -> None:
    """Anomaly rows as JSON lines; to replace a log that is being read, write to a new path."""
    df.write.mode(mode).json(path)


def write_review(df: DataFrame, path: str) -> None:
    df.select("pmid", "tf", "ensg", "direction", "cellline", "assay").write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
