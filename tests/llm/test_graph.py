import random

import pytest

from tilespark.llm import common, graph

from .test_simhash_dedup import components


@pytest.mark.parametrize("file_rows", [50_000, 40])
def test_few_links_are_written_to_few_files(spark, monkeypatch, file_rows):
    """However many partitions there are; components are those of a plain union."""
    rng = random.Random(5)
    links = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(250)) if a != b] + [(i, i + 1) for i in range(1000, 1040)]
    nodes = {i for link in links for i in link}
    monkeypatch.setattr(common, "FILE_ROWS", file_rows, raising=False)
    files, keep = [], graph.shared_checkpoint

    def counted(*given):
        files.append((out := keep(*given)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "shared_checkpoint", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files[0] == 23 and len(files) > 4 and max(files[1:]) <= -(-len(links) // file_rows)
    assert len(rows) == len(nodes) and {r["node"]: r["component"] for r in rows} == components({i: 0 for i in nodes}, links)
