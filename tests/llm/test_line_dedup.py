import duckdb
import pytest
from pyspark.sql import functions as F

from tilespark.llm import line_dedup as L
from tilespark.llm.queries import ORACLE, QUERIES

from .conftest import DOCS, awkward_rows

SF = "/root/testdata/sf0.01"


def kept(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r["kept_text_"] for r in L.drop_recurring_lines(docs, **kw).collect()}


def test_exact_lines_stay_in_the_first_document(spark):
    line = "this very line recurs in many documents"
    got = kept(spark, [f"{line}\nown words of the first one", f"second has other words here\n{line}", f"{line}\n{line}", "short line\nshort line", "short line"])
    assert got == {0: f"{line}\nown words of the first one", 1: "second has other words here", 2: "", 3: "short line\nshort line", 4: ""}


def test_short_lines_recur_too(spark):
    notice = "All rights reserved."
    got = kept(spark, [f"{notice}\nfirst text", f"second text\n{notice}\n\n", f"{notice}\nLes.", "Les.\n \n12", "12\n99"])
    assert got == {0: f"{notice}\nfirst text", 1: "second text\n\n", 2: "Les.", 3: " \n12", 4: "99"}
    assert kept(spark, ["Les. est", "Les. est"], min_tokens=3)[1] == "Les. est"


def test_one_place_is_enough_whatever_else_recurs(spark):
    line = "user said that it is fine and {} will pay for it {}".format
    texts = [line(a, b) for a in ("Alice", "Robert") for b in ("soon", "later")]  # no token is rare here
    assert kept(spark, texts) == {0: texts[0], 1: "", 2: "", 3: ""}


def test_variable_fields(spark):
    got = kept(spark, ["order 17 was shipped on 2024-01-02 to you", "order 99 was shipped on 2023-11-30 to  you", "user said that it is fine and Alice will pay for it soon", "user said that it is fine and Robert will pay for it soon", "user said that it was bad but nobody did pay at all today"])
    assert got[1] == "" and got[3] == "" and got[0] and got[2] and got[4]


def test_whole_passages(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = kept(spark, [f"intro of the first document here\n{passage}", f"{passage}\nother text that stays in it", "clean text of a document alone"])
    assert passage in got[0] and got[1] == "other text that stays in it" and got[2] == "clean text of a document alone"


def test_tree_depth_and_share(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h x y"]
    assert kept(spark, texts, constant_share=0.8)[1] == "" and kept(spark, texts, constant_share=0.9)[1] == texts[1]
    assert kept(spark, ["q b c d e f g h i j", "a b c d e f g h i j"])[1] == "a b c d e f g h i j"  # leading tokens part them


def test_variants_of_recurring_templates(spark):
    line = "user said that it is fine and {} will pay for it soon".format
    # a variant beside a line that recurs exactly, and variants that all occur in two documents
    assert [t for t in kept(spark, [line("Alice"), line("Alice"), line("Robert")]).values() if t] == [line("Alice")]
    texts = [line(n) for n in ("Alice", "Alice", "Robert", "Robert", "Carol", "Carol")]
    assert [t for t in kept(spark, texts).values() if t] == texts[:1]
    # lines that differ in more than a fifth stay, and so does what no other document has
    other = "user said that it was bad but nobody did pay at all today"
    assert kept(spark, [line("Alice"), line("Alice"), other])[2] == other


def test_templates_are_read_again_at_one_place_only(spark, monkeypatch):
    """However many copies their lines have, in texts that are alike or not."""
    counted, may_match = [], L.may_match

    def seen(rows, key, wanted):
        passed = may_match(rows, key, wanted)
        if {"raw", "line"} & set(rows.columns):
            counted.append(passed.count())
        return passed

    monkeypatch.setattr(L, "may_match", seen)
    line = "user said that it is fine and {} will pay for it soon".format
    texts = [f"{line('Alice')}\n{i} own\n{line('Robert')}" for i in range(20)] + [line("Alice"), line("Carol")] * 10
    got = kept(spark, texts)
    assert counted == [3] and got[0] == texts[0] and got[7] == "" and got[21] == ""


def test_pipeline_generalises_recurring_templates(spark):
    import corpus_pipeline

    line = "user said that it is fine and {} will pay for it soon".format
    docs = spark.createDataFrame([(i, line(n), "en", "s", 0) for i, n in enumerate(["Alice", "Alice", "Robert", "Robert"])], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()) == ["", "", "", line("Alice")]


def test_equals_duckdb(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours = QUERIES["op3_line_dedup"](spark, SF)
    columns = sorted(ours.columns)
    theirs = con.sql(ORACLE["op3_line_dedup"]).project(", ".join(columns)).fetchall()
    assert sorted(map(tuple, ours.select(*columns).collect())) == sorted(theirs)


def test_awkward(awkward, nothing):
    rows = {(r["doc_id"], r["text"]): r for r in L.drop_recurring_lines(awkward).collect()}
    assert L.drop_recurring_lines(awkward).count() == len(awkward_rows())
    assert rows[30, None]["kept_text_"] is None and rows[31, ""]["kept_text_"] == "" and rows[31, ""]["n_lines_"] == 1
    assert L.drop_recurring_lines(nothing).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(0, "a line", 7, 8, 9), (1, "a line\nb", 7, 8, 9)], "doc_id long, text string, row_ long, drops_ long, n_lines_ long")
    got = L.drop_recurring_lines(docs, kept_col="out").orderBy("doc_id").collect()
    assert [(r["out"], r["row_"], r["drops_"], r["n_lines_"], r["n_dropped_"]) for r in got] == [("a line", 7, 8, 1, 0), ("b", 7, 8, 2, 1)]


@pytest.mark.parametrize("line, masked", [("a  b", "a b"), (" a1b c", "<*> c"), ("x\ty", "x y"), ("plain line", "plain line"), ("12", "<*>"), ("\r", "")])
def test_masking(spark, line, masked):
    assert spark.createDataFrame([(line,)], "l string").select(L.masked(F.col("l"))).first()[0] == masked


def test_lines_of_numbers_are_not_equal(spark):
    texts = ["12 34 56 78 90", "7 1 2019 3 44", "Berlin 12 34 56 78", "Berlin 1 2 3 4", "12  34 56 78 90"]
    assert kept(spark, texts) == dict(enumerate(texts[:4] + [""]))
