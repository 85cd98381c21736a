"""Operators on small tables, files of every source and sink, and all queries against their SQL."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import aliases as A, curation as C, documents as D, edges as E, evaluate as V, extract as X, pieces as P, report as R, review as W
from curatrix.plans import ORACLES, QUERIES
from curatrix.sources import readers as S, writers as K
from curatrix.sources.shared import dealt


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


PRED, TRUTH = "pmid string, pos long, tf string, target string, direction string, confidence string, evidence string", "pmid string, ord long, tf string, target string, direction string"


def test_the_first_truth_decides(spark):
    truth = spark.createDataFrame([("1", 1, "A", "B", "Activation"), ("1", 2, "A", "B", "Repression")], TRUTH)
    pred = spark.createDataFrame([("1", 1, "A", "B", "Repression", "3", "e"), ("2", 1, "A", "B", "Repression", "3", "e"), ("1", 2, "X", "Y", "Activation", "9", "e")], PRED)
    assert rows(V.classify_edges(pred, truth), "pmid", "pos", "status") == [("1", 1, "Conflict"), ("1", 2, "New Found"), ("2", 1, "New")]
    assert rows(V.missed_edges(pred, truth), "ord") == [(2,)]


def test_metrics(spark):
    truth = spark.createDataFrame([("1", 1, "A", "B", "Activation"), ("1", 2, "C", "D", "Activation")], TRUTH)
    pred = spark.createDataFrame([("1", 1, "A", "B", "Activation", "3", ""), ("1", 2, "A", "B", "activation", "3", ""), ("1", 3, "X", "Y", "Activation", "3", "")], PRED)
    docs = spark.createDataFrame([("1", None, 3), ("9", "parse_fail", 0)], "pmid string, error string, n_items long")
    m = V.evaluate(pred, truth, docs).first()
    assert (m.total_pmids, m.total_matched_gt, m.total_missed, m.recall, round(m.overall_precision, 2), m.evaluable_precision, m.direction_accuracy) == (2, 1, 1, 50.0, 66.67, 100.0, 100.0)
    zero = V.evaluate(pred.where("false"), truth.where("false"), docs.where("false")).first()
    assert (zero.total_pmids, zero.recall, zero.direction_accuracy) == (0, 0.0, 0.0)
    table = R.comparison_table(pred, truth, docs)
    assert rows(table.where("pmid = '9'"), "status") == [("ERROR: parse_fail",)] and table.where("status = 'Missed'").count() == 1


OVER = [(0, "one-1", "", ["tf"], "block", "for no tf", [("FIRST",)]), (1, "one-1", "first", ["target"], None, "", None), (2, "k2", "Second", ["tf"], "map", "", None), (3, "Three/3", "third", ["target", "tf"], "map", "", None)]


def test_cascade(spark):
    over = S.normalize_overrides(spark.createDataFrame(OVER, S.OVERRIDES))
    genes = spark.createDataFrame([("MYC", "c-Myc|two", "", "E1", 1), ("MAX", "two|\"maxi\"", "oldmax", "", 2), ("ABC1", None, None, "E3", 3)], "symbol string, alias_symbol string, prev_symbol string, ensembl_gene_id string, ord long")
    cand = A.build_alias_candidates(genes)
    names = [("One-1", "tf"), ("one1", "target"), ("K2", "tf"), ("k2", "target"), ("three3", "gene"), ("three3", "target"), ("", "tf"), (None, "tf"), ("myc", "tf"), ("cmyc", None), ("two", "tf"), ("nope (x)", "tf"), ("oldmax", "gene"), ("maxi", "gene")]
    out = A.normalize_genes(spark.createDataFrame(names, "name string, role string"), over, A.official_symbols(genes), cand)
    got = {(r.name, r.role): (r.normalized, r.status) for r in out.collect()}
    assert got == {
        ("One-1", "tf"): ("ONE-1", "blocked"), ("one1", "target"): ("FIRST", "override"), ("K2", "tf"): ("SECOND", "override"), ("k2", "target"): ("K2", "unmapped"), ("three3", "gene"): ("THREE3", "unmapped"),
        ("three3", "target"): ("THIRD", "override"), ("", "tf"): ("", "empty"), (None, "tf"): ("", "empty"), ("myc", "tf"): ("MYC", "identity"), ("cmyc", "gene"): ("MYC", "hgnc_alias"), ("two", "tf"): ("TWO", "ambiguous"),
        ("nope (x)", "tf"): ("NOPE", "unmapped"), ("oldmax", "gene"): ("MAX", "hgnc_alias"), ("maxi", "gene"): ("MAX", "hgnc_alias"),
    }
    log = A.normalization_log(out)
    assert "MYC" in {r.normalized for r in log.collect()} and log.where("original = ''").count() == 0
    assert [tuple(c) for c in out.where("name = 'One-1' and role = 'tf'").first().candidates] == [("FIRST", None, "for no tf")]


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_edge_files(spark, tmp_path):
    path = write(tmp_path / "e.tsv", "A\tB\tActivation\t1;2\nC\tD\tUnknown\t2\nshort\trow\nNA\tE\tRepression\t10\n")
    edges = S.read_edges(spark, path)
    assert rows(edges, "tf", "pmid") == [("A", "1;2"), ("C", "2"), ("NA", "10")]
    by_doc = E.edges_by_doc(E.explode_doc_ids(edges))
    K.write_edges_by_doc(by_doc, str(tmp_path / "packed"))
    assert rows(S.read_edges_by_doc(spark, str(tmp_path / "packed")), "pmid", "tf", "target", "direction") == [("1", "A", "B", "Activation"), ("10", "NA", "E", "Repression"), ("2", "A", "B", "Activation")]
    assert rows(E.clean_doc_ids(spark.createDataFrame([("12.0",), (None,), ("3; x",)], "pmid string")), "pmid") == [("12",), ("3",)]


def test_order_follows_files_however_they_are_dealt(spark, tmp_path):
    """A short first file and a longer second one, which Spark reads first."""
    (tmp_path / "d").mkdir()
    write(tmp_path / "d/a.tsv", "A\tB\tActivation\t1\n")
    write(tmp_path / "d/b.tsv", "".join(f"A{i}\tB\tRepression\t1\n" for i in range(3000)) + "A\tB\tRepression\t1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        edges = S.read_edges(spark, str(tmp_path / "d"))
        assert V.first_truth(edges).where("_tf = 'A'").first().t.direction == "Activation" and E.latest_direction(edges).where("tf = 'A'").first().direction == "Repression"
        ordered = [r.tf for r in edges.orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == ["A", *(f"A{i}" for i in range(3000)), "A"]


def test_a_document_of_millions_of_edges_is_written_in_pieces(spark, tmp_path):
    """No piece has over 100,000 edges, the line is whole and in order, and other documents stand before and after it."""
    edges = spark.range(2_000_000).select(F.when(F.col("id") < 1_999_000, "9").otherwise((F.col("id") % 20).cast("string")).alias("pmid"), F.col("id").alias("ord"), F.concat(F.lit("A"), F.pmod(F.col("id") * 7919, F.lit(2_000_000)).cast("string")).alias("tf"), F.lit("B").alias("target"), F.lit("Activation").alias("direction"))
    pieces = P.edge_pieces(edges)
    sizes = pieces.groupBy("pmid").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n")).where("pmid = '9'").first()
    assert sizes.most <= 100_000 and sizes.pieces >= 20 and sizes.n == 1_999_050
    K.write_edge_pieces(pieces, str(tmp_path / "packed"))
    lines = [x for f in sorted((tmp_path / "packed").glob("part-*")) for x in f.read_text().splitlines()[1:]]
    assert [x.split("\t")[0] for x in lines] == sorted((str(i) for i in range(20)), key=int)
    pmid, n, packed = next(x for x in lines if x.startswith("9\t")).split("\t")
    entries = packed.split("; ")
    assert int(n) == len(entries) == 1_999_050 and all(e == f"A{i * 7919 % 2_000_000}->B(Activation)" for i, e in enumerate(entries[:1_999_000]))
    assert not list((tmp_path / "packed").glob("_pending*"))


def test_dictionary_files(spark, tmp_path):
    path = write(tmp_path / "d.tsv", 'hgnc_id\tsymbol\talias_symbol\tprev_symbol\tensembl_gene_id\n1\tMYC\t"c-Myc|two"\t\tE1\n2\tMAX\ttwo\told-max\tE2\n')
    genes = S.read_gene_dictionary(spark, path)
    cand, over = A.build_alias_candidates(genes), S.normalize_overrides(spark.createDataFrame(OVER, S.OVERRIDES))
    assert rows(A.alias_conflicts(cand), "key") == [("TWO",)]
    assert tuple(A.alias_metadata(genes, cand, over).first()) == (2, 5, 1, 4)
    K.write_alias_index({"candidates": cand, "official": A.official_symbols(genes), "unique": A.unique_alias_map(cand, over)}, str(tmp_path / "index"))
    back, official = S.read_alias_index(spark, str(tmp_path / "index"), rows=True)
    assert rows(back, "key", "symbol", "sources") == rows(cand, "key", "symbol", "sources") and rows(official, "symbol") == [("MAX",), ("MYC",)]
    K.write_ensg_map(A.build_ensg_map(genes), str(tmp_path / "ensg"))
    assert rows(S.read_ensg_map(spark, str(tmp_path / "ensg"), rows=True), "symbol", "ensg") == [("MAX", "E2"), ("MYC", "E1")]
    K.write_overrides(over, str(tmp_path / "over"))
    assert rows(S.read_overrides(spark, str(tmp_path / "over"), rows=True), "ord", "alias", "roles", "action", "candidates") == rows(over, "ord", "alias", "roles", "action", "candidates")
    index = write(tmp_path / "i.json", json.dumps({"official_symbols": ["MYC"], "aliases": {"CMYC": [{"symbol": "MYC", "sources": ["a"]}]}}))
    candidates, official = S.read_alias_index(spark, index)
    assert rows(candidates, "key", "symbol") == [("CMYC", "MYC")] and rows(official, "symbol") == [("MYC",)]
    legacy = write(tmp_path / "l.json", '{"X1": "MYC"}')
    candidates, official = S.read_alias_index(spark, str(tmp_path / "none.json"), legacy)
    assert rows(candidates, "key", "symbol") == [("X1", "MYC")] and rows(official, "symbol") == [("MYC",)]
    assert rows(S.read_ensg_map(spark, legacy), "symbol", "ensg") == [("X1", "MYC")]
    arrays = write(tmp_path / "o.json", '[{"alias": "k2", "symbol": "S", "roles": ["TF "]}, {"alias": "b", "action": "Block"}]')
    assert rows(S.read_overrides(spark, arrays), "ord", "alias", "roles", "action") == [(0, "k2", ["tf"], "map"), (1, "b", [], "block")]
    assert rows(S.read_overrides(spark, legacy), "alias", "symbol", "roles") == [("X1", "MYC", ["tf", "target"])]


def test_review_files(spark, tmp_path):
    gold = S.read_gold_pairs(spark, write(tmp_path / "g.tsv", "1\tmyc\tmax\n2\tshort\n"))
    assert rows(gold, "pmid", "tf", "target") == [("1", "MYC", "MAX")]
    assert rows(S.read_track_tfs(spark, write(tmp_path / "t.txt", "c\t1\tCHIP:myc:K562\nc\t1\tDNASE:x:y\n\nc\tCHIP\n")), "tf") == [("MYC",)]
    review = S.read_review(spark, write(tmp_path / "r.tsv", "1\ta\tb\t\tc1\ta1\n1\ta\tb\tActivation\tc2\ta2\n1\ta\tb\tRepression\tc3\ta3\n2\ta\tb\t\tx\ty\n2\ta\tb\t\tlast\tz\nshort\t1\n"))
    assert rows(review, "pmid", "direction", "cellline") == [("1", "Activation", "c2"), ("2", "", "last")]
    export = spark.createDataFrame([("1", "A", "E1", "Activation", "", "x")], "pmid string, tf string, ensg string, direction string, cellline string, assay string")
    K.write_review(export, str(tmp_path / "out"))
    assert rows(S.read_review(spark, str(tmp_path / "out")), "pmid", "direction", "cellline", "assay") == [("1", "Activation", "", "x")]


def test_anomaly_files(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"pmid": "1", "anomaly_type": "other", "trrust_entry": "A->B (x)", "issue": "i", "curated_date": "2026-05-10"}\n\nnot json\n{"pmid": "", "issue": "x"}\n')
    log = S.read_anomalies(spark, path)
    assert rows(log, "pmid", "issue") == [("1", "i")] and S.read_anomalies(spark, str(tmp_path / "none")).count() == 0
    new = spark.createDataFrame([("2", "other", "A->B (x)", "i", None, None), ("2x", "other", "A->B (x)", "i", None, None), ("3", "odd", "A->B (x)", "i", None, None), ("4", "other", "AB", "i", None, None), ("5", "other", "A->B (x)", " ", None, None), ("6", None, None, None, None, None)], S.ANOMALIES)
    accepted, rejected = C.append_anomalies(log, new)
    assert rows(accepted, "pmid") == [("1",), ("2",)] and rows(rejected, "reject_reason") == [("anomaly_type",), ("anomaly_type",), ("entry",), ("issue",), ("pmid",)]
    K.write_anomalies(accepted, str(tmp_path / "log"))
    assert S.read_anomalies(spark, str(tmp_path / "log")).count() == 2
    assert rows(C.list_anomalies(accepted, ["pmid"]), "number", "pmid") == [(1, "1"), (2, "2")] and rows(C.remove_anomaly(accepted, 1, ["pmid"]), "pmid") == [("2",)]
    K.write_excluded(accepted, str(tmp_path / "ex"))
    assert rows(spark.read.json(str(tmp_path / "ex")), "pmid") == [("1",), ("2",)]


def test_document_files(spark, tmp_path):
    edges = [("A", "B", "Activation")]
    docs = spark.createDataFrame([("1", "plain text", [], edges), ("2", None, [("RESULTS", "r"), ("[Odd]", "o")], []), ("3", None, [], [])], "pmid string, abstract string, sections array<struct<label:string,text:string>>, edges array<struct<tf:string,target:string,direction:string>>")
    K.write_document_blocks(docs, str(tmp_path / "b"))
    out = {r.pmid: r for r in S.read_document_blocks(spark, str(tmp_path / "b"), drop_rule=True).collect()}
    assert out["1"].abstract == "plain text" and [tuple(e) for e in out["1"].edges] == edges and out["2"].abstract == "[RESULTS]\nr\n\n[Odd]\no" and out["3"].abstract == "Abstract not found in PubMed"
    assert S.read_document_blocks(spark, str(tmp_path / "b")).where("pmid = '1'").first().abstract == "plain text\n\n---"
    xml = "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Abstract><AbstractText Label=\"Results\">r <i>x</i> &lt; y</AbstractText><AbstractText>loose</AbstractText><AbstractText Label=\"Odd\">o</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>8</PMID><Article><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>9</PMID><Article></Article></MedlineCitation></PubmedArticle></Set>"
    out = {r.pmid: r for r in S.read_articles_xml(spark, write(tmp_path / "x.xml", xml)).collect()}
    assert [tuple(s) for s in out["7"].sections] == [("RESULTS", "r x < y"), ("[Odd]", "o")] and out["8"].abstract == "a b" and out["9"].abstract == ""


def test_response_files(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps({"1": [{"TF": "A", "target": "B", "Direction": "x", "confidence": 4, "evidence": None}, 7], "2": {"error": "parse_fail"}, "3": []}))
    edges, docs = S.read_extractions(spark, path)
    assert rows(edges, "pmid", "pos", "tf", "target", "direction", "confidence", "evidence") == [("1", 0, "A", "B", "x", "4", "")]
    assert rows(docs, "pmid", "error", "n_items") == [("1", None, 2), ("2", "parse_fail", 0), ("3", None, 0)]
    debug = S.read_debug(spark, write(tmp_path / "d.json", json.dumps({"1": {"round1_analysis": "a", "round1_usage": {"input_tokens": 3}, "round2_raw": "[]"}, "2": {"error": "x"}})))
    assert rows(R.debug_table(debug), "pmid", "round1_tokens") == [("1", "in:3 out:0")] and rows(X.token_usage(debug), "pmid", "total_in") == [("1", 3), ("2", 0)]
    K.write_extractions(edges, docs, str(tmp_path / "out"))
    edges2, docs2 = S.read_extractions(spark, str(tmp_path / "out"), rows=True)
    assert rows(edges2, *edges.columns) == rows(edges, *edges.columns) and rows(docs2, *docs.columns) == rows(docs, *docs.columns)
    K.write_debug(debug, str(tmp_path / "debug"))
    assert rows(S.read_debug(spark, str(tmp_path / "debug"), rows=True), *debug.columns) == rows(debug, *debug.columns)
    K.write_report({"docs": docs, "edges": edges}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/docs")).count() == 3


def test_extraction_keeps_failures_as_rows(spark):
    calls = []

    def client(messages):
        if "boom" in messages[0]["content"]:
            raise ValueError("refused")
        if "busy" in messages[0]["content"]:
            raise X.RateLimited
        return {"text": '[{"TF": "a"}]', "request_id": "r", "input_tokens": 1}

    df = spark.createDataFrame([("1", "fine"), ("2", "boom"), ("3", "busy"), ("4", None)], "pmid string, text string")
    out = X.extract(df, client, "Q", "J", workers=2, delays=(0, 0, 0))
    assert rows(out, "pmid", "error") == [("1", None), ("2", "refused"), ("3", "Round1_API_Error: rate_limit_exhausted"), ("4", None)]
    waits = []
    assert X.with_retry(lambda m: (_ for _ in ()).throw(X.RateLimited()), [], sleep=waits.append) is None and waits == [1, 2, 4] and not calls


@pytest.mark.parametrize("workers", [1, 3])
def test_a_killed_task_repeats_no_answered_call(spark, tmp_path, workers):
    """A client that ends its Python worker once, in the middle: calls are counted in a file, answers are kept."""
    log, flag, folder = str(tmp_path / "calls"), str(tmp_path / "killed"), f"file:{tmp_path}/answers"

    def client(messages):
        with open(log, "a") as f:
            f.write(f"{messages[0]['content'].split()[0]} {len(messages)}\n")
        if messages[0]["content"].startswith("d13 ") and not os.path.exists(flag):
            open(flag, "w").close()
            os._exit(1)
        return {"text": "t" * len(messages), "input_tokens": 1}

    df = spark.createDataFrame([(str(i), f"d{i} text") for i in range(40)], "pmid string, text string")
    ask = lambda first="Q": X.extract(df, client, first, "J", workers, answers=folder)
    with pytest.raises(Exception, match="crashed|exited|EOF"):
        ask().collect()
    time.sleep(3)  # other tasks of the failed job may still be at it
    before = len(open(log).read().split("\n")) - 1
    got = ask().collect()
    assert sorted(r.pmid for r in got) == sorted(str(i) for i in range(40)) and all(r.round1_analysis == "t" and r.round2_raw == "ttt" and r.round1_usage.input_tokens == 1 and r.error is None for r in got)
    calls = open(log).read().split("\n")[:-1]
    assert 80 < len(calls) <= 80 + workers and len(set(calls)) == 80 and calls.count("d13 1") == 2  # each task may lose the call that it is waiting for
    assert 0 < before < len(calls)
    ask().collect()
    assert len(X.extract(df, client, "Q", "J", workers + 1, answers=folder).collect()) == 40 and open(log).read().split("\n")[:-1] == calls  # later runs ask nothing, whatever their parts
    ask("other").collect()
    assert len(open(log).read().split("\n")[:-1]) == len(calls) + 80  # another template is another question


def test_attempts_of_one_run_read_what_earlier_ones_left(tmp_path):
    kept = X.Answers(str(tmp_path / "a"), 3)
    assert kept.get("1", 1, "q", [], lambda: {"text": "x"}) == {"text": "x"} and kept.get("2", 1, "q", [], lambda: None) is None
    name = next((tmp_path / "a/part-3").iterdir())
    with open(name, "a") as f:
        f.write('{"pmid": "9", "round": 1, "as')  # cut off
    again = X.Answers(str(tmp_path / "a"), 3)
    assert again.get("1", 1, "q", [], lambda: {"text": "new"}) == {"text": "x"} and again.get("1", 1, "other", [], lambda: {"text": "new"}) == {"text": "new"} and again.get("9", 1, "q", [], lambda: {"text": "y"}) == {"text": "y"}


def test_a_log_is_rewritten_while_it_is_read(spark, tmp_path):
    from curatrix.operators.anomaly_log import AnomalyLog, ChangedMeanwhile

    entry = lambda *pmids: spark.createDataFrame([(p, "other", "A->B (x)", f"issue {p}", None, None) for p in pmids], S.ANOMALIES)
    log = AnomalyLog(spark, f"file:{tmp_path}/log")
    assert log.version() == 0 and log.read().count() == 0 and log.listed().count() == 0
    log.append(entry("7", "3").coalesce(1))
    rejected = log.add(entry("5", "x"))
    assert [r.pmid for r in rejected.collect()] == ["x"] and rows(log.listed(), "number", "pmid") == [(1, "7"), (2, "3"), (3, "5")]
    seen, reader = log.version(), log.read()
    assert log.remove(2) == 3 and rows(log.listed(), "number", "pmid") == [(1, "7"), (2, "5")]
    assert rows(reader, "pmid") == [("3",), ("5",), ("7",)] == rows(log.read(seen), "pmid")  # who reads a version stays on it
    with pytest.raises(ChangedMeanwhile):
        log.rewrite(entry("1"), based_on=seen)
    (tmp_path / "log/versions/00000004.json").write_text('["da')  # a writer that has not finished, or never will
    assert AnomalyLog(spark, f"file:{tmp_path}/log").version() == 3 and rows(log.read(), "pmid") == [("5",), ("7",)]


@pytest.mark.parametrize("n", [0, 1, 50, 400, 999, 1000, 5000])
def test_large_samples_equal_sorted_ones(spark, monkeypatch, n):
    df = spark.range(2000).select((F.col("id") % 1000).cast("string").alias("pmid"), "id")
    small = rows(E.sample_docs(df, n, "s"), "pmid", "id")
    monkeypatch.setattr(E, "FEW", 7)
    monkeypatch.setattr(E, "DIGITS", 1)
    assert rows(E.sample_docs(df, n, "s"), "pmid", "id") == small and len(small) == 2 * min(n, 1000)


def test_a_large_sample_has_no_single_task_that_sorts_it(spark):
    df = spark.range(60_000).select(F.col("id").cast("string").alias("pmid"))
    out = E.sample_docs(df, 20_000, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20_000 and "TakeOrderedAndProject(limit=20000" not in plan


def test_sections_and_prompts(spark):
    df = spark.createDataFrame([("1", 0, "A", "x"), ("1", 1, "B", "y"), ("1", 2, "A", "z")], "pmid string, ord int, label string, text string")
    assert rows(D.dedupe_sections(df), "label", "ord", "text") == [("A", 0, "z"), ("B", 1, "y")]
    text = spark.createDataFrame([("1", "X acts via Y. Nothing here. Knockdown of X matters!", "a")], "pmid string, text string, round1_answer string")
    assert rows(D.cue_sentences(text), "pos") == [(0,)] and rows(D.cue_sentences(text, cues=T.PERTURBATION_CUES), "pos") == [(2,)]
    assert [m["role"] for m in D.build_prompts(text, "Q", "J").first().round2] == ["user", "assistant", "user"]


def test_review_edits(spark):
    state = spark.createDataFrame([("1", "Activation", "K562", "", "", False)], "pmid string, direction string, cellline string, assay string, notes string, reviewed boolean")
    edits = spark.createDataFrame([("1", None, None, "ChIP", None), ("2", "Repression", None, None, None)], "pmid string, direction string, cellline string, assay string, notes string")
    assert rows(W.merge_review(state, edits), "pmid", "assay", "reviewed") == [("1", "ChIP", True), ("2", "", False)]


def normal(v):
    return float(v) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda table: sorted(repr([normal(v) for v in r]) for r in table)
    mine = key(tuple(r) for r in got.select(*columns).collect())
    assert mine and mine == key(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_the_cascade_has_every_status(spark, sf):
    assert {r.status for r in QUERIES["normalize_genes"](spark, sf).select("status").distinct().collect()} == set(A.STATUSES)


def test_a_third_is_missed(spark, sf):
    m = QUERIES["edge_metrics"](spark, sf).first()
    assert 0.2 < m.total_missed / m.total_gt < 0.6


def test_metric_totals_agree(spark, sf):
    m = QUERIES["edge_metrics"](spark, sf).first()
    assert m.total_matched_gt + m.total_missed == m.total_gt and m.total_consistent + m.total_conflict + m.total_new_found + m.total_new == m.total_llm
    assert m.total_consistent and m.total_conflict and m.total_new_found and m.total_new


def agrees(spark, folder, texts, *names):
    """The queries on documents of these (language, text) against their SQL."""
    import duckdb

    docs = [(i, t, lang, "web", len(t)) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for name in names:
        df = QUERIES[name](spark, str(folder))
        wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(wanted, key=str), name


def test_cues_end_where_words_of_any_script_do(spark, tmp_path):
    told = "Un ado parañado. Va para\u0301. Otro para el.\u00a0Más,para! PARA\x0b"
    agrees(spark, tmp_path, [("es", told), ("en", "Rugbyé by ýby.\u2003by \u3000"), ("fr", "of the_ of the² of the.")], "cue_sentences", "mechanism_sentences", "perturbation_sentences")
    df = spark.createDataFrame([("1", told)], "pmid string, text string")
    assert rows(D.cue_sentences(df, cues=["para"]), "pos", "sentence") == [(2, "Otro para el."), (3, "Más,para!"), (4, "PARA")]


def test_last_sections_without_text_stay(spark, tmp_path):
    agrees(spark, tmp_path, [("fr", "A."), ("es", "É"), ("en", "A"), ("en", ""), ("fr", ""), ("de", ""), ("en", "\u00a0x y\u3000"), ("es", " \x0b\n "), ("de", "plain\u2003")], "document_blocks", "file_blocks")


def test_line_items_are_dealt_once_with_their_own_columns(spark, sf):
    from curatrix.plans import text_queries as Q
    from curatrix.plans.views import view

    plan = Q._responses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Window") > plan.index("ObjectHashAggregate")
    assert "mutagenesis" not in plan[plan.index("Exchange hashpartitioning") :]
    assert view(spark, sf, "pred").columns[:2] == ["pmid", "pos"] and dict(view(spark, sf, "truth").dtypes)["ord"] == "bigint"


def test_extraction_rows_of_odd_results(spark):
    texts = ['[{"TF":"A","tf":"a","TARGET":"B","confidence":3,"Evidence":null},7,null,"x",[1],{}]', '{"error":"late"}', '{"tf":"A"}', '"text"', "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "pmid int, t string").select("pmid", F.try_parse_json("t").alias("v"))
    got = {r.pmid: (r.error, r.n_items, [tuple(e) for e in r.edges]) for r in S.extraction_rows(df).collect()}
    assert got == {0: (None, 6, [(0, "a", "B", "", "3", ""), (5, "", "", "", "", "")]), 1: ("late", 0, []), 2: (None, 0, []), 3: (None, 0, []), 4: (None, 0, [])}


GENES = "symbol string, alias_symbol string, prev_symbol string, ensembl_gene_id string, ord long"


def test_aliases_are_cleaned_once(spark):
    """The plan cleans aliases once, in the generators, and symbols where they are filtered and named; before, each filter and key worked an alias out anew."""
    plan = A.build_alias_candidates(spark.createDataFrame([("S", "al-1|AL2 (x)", "al-1", "", 1)], GENES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\(.*?\)") <= 8


def test_candidates_of_odd_aliases(spark):
    genes = spark.createDataFrame([("s", 'a-b c|"A-B C"||12.5| x |(only)|---|S|nil(1)', "A-B C", "", 1), ("", "lost", "lost", "", 2), ("t", None, None, "", 3), (None, "gone", None, "", 4)], GENES)
    found = [(r.key, r.symbol, r.sources) for r in A.build_alias_candidates(genes).orderBy("key").collect()]
    both = ["hgnc_alias_symbol", "hgnc_prev_symbol"]
    assert found == [("A-B C", "S", both), ("ABC", "S", both), ("NIL", "S", both[:1])]


def test_keys_with_many_candidates_fall_into_several_tasks(spark, tmp_path, monkeypatch):
    """Ranges of keys go by their candidates; by keys alone, these four would be one task's."""
    got = []
    monkeypatch.setattr(K.J, "write_entries", lambda df, *a, **k: got.append(df))
    heavy = [(f"heavy{i}", f"S{j}") for i in range(4) for j in range(1000)]
    cand = spark.createDataFrame([(k, s, ["x"]) for k, s in heavy + [(f"a{i}", "S") for i in range(1000)]], "key string, symbol string, sources array<string>")
    K.write_alias_index({"candidates": cand, "official": cand.select("symbol").distinct()}, str(tmp_path), rows=False)
    parts = got[0].where("member = 'aliases'").select("key", F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in parts if r.key.startswith("heavy")}) > 1
    assert [r.key for r in sorted(parts, key=lambda r: r.p)] == sorted({k for k, _ in heavy} | {f"a{i}" for i in range(1000)})


def test_the_unique_map_reads_its_tables_once(spark, tmp_path):
    """Candidates and overrides: before, overrides were read three times."""
    spark.createDataFrame([("A1B", "S1", ["x"]), ("A2B", "S1", ["x"]), ("A2B", "S2", ["x"]), ("A3B", "S3", ["x"]), ("A4B", "S4", ["x"])], "key string, symbol string, sources array<string>").write.parquet(f"{tmp_path}/c")
    over = [(1, "a3b", "", ["tf"], "block", "", None), (2, "a2b", "s9", ["tf", "target"], "map", "", None), (3, "a2b", "s8", [], "map", "", None), (4, "a4b", "", [], "map", "", None), (5, "new", "s5", ["all"], "map", "", None), (6, "(x)", "s6", [], "map", "", None), (7, "new", "s7", ["target"], "map", "", None)]
    spark.createDataFrame(over, S.OVERRIDES).write.parquet(f"{tmp_path}/o")
    df = A.unique_alias_map(spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/o"))
    assert rows(df, "key", "symbol") == [("A1B", "S1"), ("A2B", "S8"), ("A4B", "S4"), ("NEW", "S5")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_pairs_lie_where_line_items_were_dealt(spark, sf):
    """One exchange of the rows, whatever Spark makes of the size of tables behind a lookup."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        plan = QUERIES["review_pieces"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_own_directions_are_those_looked_up(spark):
    edges = [("1", 1, "A", "B", "x"), ("1", 2, "A", "B", "y"), ("1", 3, "A", "C", None), ("2", 1, "A", "B", "z"), (None, 1, "A", "B", "z"), ("2", 2, None, "B", "z"), ("2", 3, "A", None, "z")]
    df = spark.createDataFrame(edges, "pmid string, ord long, tf string, target string, direction string")
    told = [rows(x, "pmid", "ord", "tf", "target", "reference_direction") for x in (W.own_direction(df), W.lookup_direction(df, E.latest_direction(df)))]
    assert told[0] == told[1] and ("1", 1, "A", "B", "y") in told[0] and (None, 1, "A", "B", "") in told[0]


def test_names_are_attached_with_null_ones(spark):
    df = spark.createDataFrame([("1", "A"), ("2", None), ("3", "A")], "pmid string, tf string")
    names = W.attach_aliases(df.select("tf").distinct(), spark.createDataFrame([("A", ["AA"])], "symbol string, aliases array<string>"))
    assert rows(W.attach_names(df, "tf", names), "pmid", "tf", "tf_aliases") == [("1", "A", ["AA"]), ("2", None, []), ("3", "A", ["AA"])]


@pytest.mark.parametrize("large", [20, 10_000])
def test_pieces_of_large_and_small_documents(spark, monkeypatch, large):
    monkeypatch.setattr(P, "LARGE", large)
    sizes = {"1": 1, "2": 4, "3": 20, "4": 21, "5": 100, None: 30}
    edges = spark.createDataFrame([(k, i * 7 % n if n % 7 else i, f"A{i}") for k, n in sizes.items() for i in range(n)], "pmid string, ord long, tf string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = P.in_pieces(edges, ["ord"], 3).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {}
    for r in sorted(found, key=lambda r: (r.piece, r.ord)):
        got.setdefault(r.pmid, []).append(r)
    assert {k: [r.ord for r in v] for k, v in got.items()} == {k: list(range(n)) for k, n in sizes.items()}
    for k, v in got.items():
        counts = [sum(r.piece == p for r in v) for p in {r.piece for r in v}]
        assert max(counts) <= 3 and (sizes[k] > large or len(counts) == -(-sizes[k] // 3))
    ranges = {k: {r.piece >> 32 for r in v} for k, v in got.items()}
    assert all(x == {0} for k, x in ranges.items() if sizes[k] <= large) and (large > 20 or len(set.union(*ranges.values())) > 1)


def test_rows_of_a_task_are_bounded_where_partitions_are_few(spark):
    ids = spark.range(10_000)
    assert dealt(ids, "id", 1000).rdd.getNumPartitions() == 10 and dealt(ids, "id", 2500).rdd.getNumPartitions() == ids.rdd.getNumPartitions()
