import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 9)), ","]) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    base = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "de"]), f"s{i % 3}", 0) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \t\n\r ", "en", None, 0), (33, base, "en", "s1", 0), (34, base, "en", "s1", 0), (34, base, "en", "s1", 0)]
    rows += [(35, base.replace("alpha", "ALPHA"), "en", "s2", 0), (36, "x" * 200_000, "en", "s2", 0), (37, "one two", "en", "s2", 0), (None, "no id here at all", "en", "s1", 0), (38, "12345 !!! 67890", None, "s0", 0)]
    rows += [(39, prose(rng, 20_000), "de", "s0", 0), (40, "line one of the text here\nline one of the text here\n\nlast", "en", "s0", 0), (41, "𝔘𝔫𝔦 ünïcödé İ ß", "de", "s1", 0)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with columns that clash with names the operators use."""
    from pyspark.sql import functions as F

    clash = ("size", "target", "bucket", "template", "fp", "component", "score", "part", "kind", "line", "p", "label", "vec", "node", "block", "place", "spans")
    return spark.createDataFrame(awkward_rows(), DOCS).withColumns({c: F.lit("clash") for c in clash}).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")
