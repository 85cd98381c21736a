"""The alias dictionary, and the cascade that normalises names: override, identity, unique alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curatrix.functions import text as T

# Statuses, and the sources' words below.
STATUSES = ["empty", "override", "identity", "hgnc_alias", "ambiguous", "unmapped", "blocked"]


# ---- building ------------------------------------------------------------------------------------------


def dictionary_aliases(genes: DataFrame) -> DataFrame:
    """symbol, alias (its clean key), source of a dictionary: current aliases and previous symbols.

    A dictionary is a small file with much work to each row, so rows are dealt first. An alias is cleaned once, within the
    generator: what comes after it only names its output. A plain explode would work its array out again to filter empty ones.
    """
    cells, spark = ["symbol", "alias_symbol", "prev_symbol"], genes.sparkSession
    dealt = genes.select(*cells).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *cells)
    aliases = lambda c: F.explode_outer(F.transform(T.split_aliases(c), T.clean_key)).alias("alias")
    parts = [dealt.select(T.clean_key("symbol").alias("symbol"), aliases(c), F.lit(f"hgnc_{c}").alias("source")) for c in ("alias_symbol", "prev_symbol")]
    return parts[0].unionByName(parts[1]).where((F.col("symbol") != "") & (F.col("alias") != F.col("symbol")))


def build_alias_candidates(genes: DataFrame) -> DataFrame:
    """key, symbol, sources: every key of every valid alias."""
    compact = F.nullif(T.compact_clean("alias"), F.col("alias"))
    rows = dictionary_aliases(genes).where(T.is_strong_key("alias")).select(F.explode(F.array("alias", compact)).alias("key"), "symbol", "source").where("key <> ''")
    # Flags and not a set of texts, which Spark would sort before it combines them.
    sources = ["hgnc_alias_symbol", "hgnc_prev_symbol"]
    found = rows.groupBy("key", "symbol").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in sources])
    return found.select("key", "symbol", F.array_compact(F.array(*[F.when(F.col(s), s) for s in sources])).alias("sources"))


def alias_conflicts(candidates: DataFrame) -> DataFrame:
    """key, symbols of keys that stand for more than one symbol."""
    return candidates.groupBy("key").agg(F.sort_array(F.collect_set("symbol")).alias("symbols")).where(F.size("symbols") > 1)


def unique_alias_map(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """key, symbol: keys of one symbol that no role has for itself, under the overrides that hold for all roles (the last one wins)."""
    everywhere = (F.size("roles") == 0) | (F.array_sort("roles") == F.array(F.lit("all"))) | (F.array_sort("roles") == F.array(F.lit("target"), F.lit("tf")))
    # explode_outer, since a plain explode would work its array out twice.
    keyed = overrides.select("ord", everywhere.alias("everywhere"), T.clean_key("symbol").alias("to"), F.explode_outer(T.key_variants("alias")).alias("key")).where("key is not null")
    holds = F.expr("everywhere and to <> ''")
    # One row for each key with an override: whether a role has it for itself, and the symbol that holds for all.
    over = keyed.groupBy("key").agg(F.bool_or(~F.col("everywhere")).alias("special"), F.bool_or(holds).alias("holds"), F.max_by(F.when(holds, F.col("to")), F.when(holds, F.col("ord"))).alias("to"))
    single = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("symbol").alias("symbol")).where("n = 1").select("key", "symbol")
    both = single.join(over, "key", "full")
    return both.where("holds or (symbol is not null and not coalesce(special, false))").select("key", F.when(F.col("holds"), F.col("to")).otherwise(F.col("symbol")).alias("symbol"))


def official_symbols(genes: DataFrame) -> DataFrame:
    return genes.select(T.clean_key("symbol").alias("symbol")).where("symbol <> ''").distinct()


def alias_metadata(genes: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row of counts: genes, aliases, conflicts, overrides."""
    counts = [
        genes.where(T.clean_key("symbol") != "").select(F.lit("genes_processed").alias("name"), F.lit(1).alias("one")),
        candidates.select("key").distinct().select(F.lit("alias_count").alias("name"), F.lit(1).alias("one")),
        alias_conflicts(candidates).select(F.lit("conflict_count").alias("name"), F.lit(1).alias("one")),
        overrides.select(F.lit("override_count").alias("name"), F.lit(1).alias("one")),
    ]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return rows.agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("genes_processed", "alias_count", "conflict_count", "override_count")])


def reverse_aliases(candidates: DataFrame) -> DataFrame:
    """symbol, aliases: all keys of a symbol but itself, sorted."""
    symbol = F.upper(T.strip("symbol"))
    return candidates.select(symbol.alias("symbol"), F.upper("key").alias("key")).groupBy("symbol").agg(F.sort_array(F.collect_set(F.when(F.col("key") != F.col("symbol"), F.col("key")))).alias("aliases"))


def build_ensg_map(genes: DataFrame) -> DataFrame:
    """symbol, ensg: of rows with both; the last row of a symbol wins."""
    rows = genes.select(F.upper(T.strip("symbol")).alias("symbol"), T.strip("ensembl_gene_id").alias("ensg"), "ord").where("symbol <> '' and ensg <> ''")
    return rows.groupBy("symbol").agg(F.max_by("ensg", "ord").alias("ensg"))


# ---- looking up ----------------------------------------------------------------------------------------


def keyed_names(names: DataFrame) -> DataFrame:
    """name, role, pos, key of distinct (name, role)."""
    return names.select("name", "role", F.posexplode(T.key_variants("name")).alias("pos", "key"))


def lookup_override(keyed: DataFrame, overrides: DataFrame) -> DataFrame:
    """name, role, o: the first override with a common key and role that blocks or has a symbol."""
    rows = overrides.withColumn("symbol", F.upper(T.strip(F.coalesce("symbol", F.lit(""))))).where((F.col("action") == "block") | (F.col("symbol") != ""))
    rows = rows.select(F.explode(T.key_variants("alias")).alias("key"), F.struct("ord", "alias", "symbol", "action", "reason", "candidates").alias("o"), "roles")
    fits = (F.size("roles") == 0) | F.array_contains("roles", "all") | F.expr("array_contains(roles, lower(trim(role)))")
    return keyed.join(rows, "key").where(fits).groupBy("name", "role").agg(F.min_by("o", "o.ord").alias("o"))


def lookup_identity(keyed: DataFrame, official: DataFrame) -> DataFrame:
    """name, role, identity: the first key that is an official symbol."""
    return keyed.join(official.select(F.col("symbol").alias("key")), "key").groupBy("name", "role").agg(F.min_by("key", "pos").alias("identity"))


def lookup_alias(keyed: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, role, a: key, symbols and candidates of the first key that has any."""
    clean = F.upper(T.strip("symbol"))
    by_key = candidates.where(clean != "").groupBy("key").agg(F.sort_array(F.collect_set(clean)).alias("symbols"), F.sort_array(F.collect_list(F.struct("symbol", "sources"))).alias("candidates"))
    return keyed.join(by_key, "key").groupBy("name", "role").agg(F.min_by(F.struct("key", "symbols", "candidates"), "pos").alias("a"))


CANDIDATE = "array<struct<symbol:string,sources:array<string>,reason:string>>"


def normalize_genes(names: DataFrame, overrides: DataFrame, official: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, role and the result: normalized, status, source, candidates, matched_key for each distinct (name, role).

    Every stage gives at most one row for a name, so no join multiplies; the order of stages is in the
    coalescing, and Spark may join in any order.
    """
    names = names.select("name", F.coalesce("role", F.lit("gene")).alias("role")).distinct()
    keyed = keyed_names(names)
    same = lambda x: [F.col("n.name").eqNullSafe(F.col(f"{x}.name")), F.col("n.role") == F.col(f"{x}.role")]
    df = names.alias("n").join(lookup_override(keyed, overrides).alias("v"), same("v"), "left").join(lookup_identity(keyed, official).alias("i"), same("i"), "left").join(lookup_alias(keyed, candidates).alias("l"), same("l"), "left")
    df = df.select("n.name", "n.role", T.clean_key("n.name").alias("clean"), "v.o", "i.identity", "l.a")
    empty, blocked, over = F.col("clean") == "", F.col("o.action") == "block", F.col("o").isNotNull()
    same_symbol, one, many = F.col("identity").isNotNull(), F.size("a.symbols") == 1, F.size("a.symbols") > 1

    def pick(default: Column, **by: Column) -> Column:
        out = F.when(empty, by["empty"])
        for condition, value in ((blocked, "blocked"), (over, "over"), (same_symbol, "identity"), (one, "alias"), (many, "many")):
            out = out.when(condition, by[value])
        return out.otherwise(default)

    none = F.lit(None).cast(CANDIDATE)
    listed = F.coalesce(F.transform("a.candidates", lambda c: F.struct(c.symbol.alias("symbol"), c.sources.alias("sources"), F.lit(None).cast("string").alias("reason"))).cast(CANDIDATE), none)
    blocked_list = F.transform(F.coalesce("o.candidates", F.array().cast("array<struct<symbol:string>>")), lambda c: F.struct(F.coalesce(c.symbol, F.lit("")).alias("symbol"), F.lit(None).cast("array<string>").alias("sources"), F.col("o.reason").alias("reason"))).cast(CANDIDATE)
    over_list = F.array(F.struct(F.col("o.symbol").alias("symbol"), F.lit(None).cast("array<string>").alias("sources"), F.col("o.reason").alias("reason"))).cast(CANDIDATE)
    identity_list = F.array(F.struct(F.col("identity").alias("symbol"), F.array(F.lit("official_symbol")).alias("sources"), F.lit(None).cast("string").alias("reason"))).cast(CANDIDATE)
    text = F.lit
    return df.select(
        "name", "role", T.strip(F.coalesce("name", text(""))).alias("original"),
        pick(F.col("clean"), empty=text(""), blocked=F.col("clean"), over=F.col("o.symbol"), identity=F.col("identity"), alias=F.get("a.symbols", F.lit(0)), many=F.col("clean")).alias("normalized"),
        pick(text("unmapped"), empty=text("empty"), blocked=text("blocked"), over=text("override"), identity=text("identity"), alias=text("hgnc_alias"), many=text("ambiguous")).alias("status"),
        pick(text("none"), empty=text("none"), blocked=text("curated_override"), over=text("curated_override"), identity=text("hgnc_official_symbol"), alias=text("hgnc_alias_index"), many=text("hgnc_alias_index")).alias("source"),
        F.coalesce(pick(none, empty=none, blocked=blocked_list, over=over_list, identity=identity_list, alias=listed, many=listed), F.array().cast(CANDIDATE)).alias("candidates"),
        pick(text(""), empty=text(""), blocked=F.col("o.alias"), over=F.col("o.alias"), identity=F.col("identity"), alias=F.col("a.key"), many=F.col("a.key")).alias("matched_key"),
    )


def normalization_log(normalized: DataFrame, *more: str) -> DataFrame:
    """The names that changed or were not simply official, with more of their columns if asked for."""
    return normalized.where((F.col("original") != "") & ~((F.col("original") == F.col("normalized")) & F.col("status").isin("", "identity"))).select("original", "normalized", F.col("role").alias("type"), "status", "source", "candidates", "matched_key", *more)
