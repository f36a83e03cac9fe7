"""Updates of the chunk store embed what is new, once, and nothing else."""

from __future__ import annotations

import numpy as np
import pytest

from tracegrove.operators import chunkstore, dense
from tracegrove.sources import store

FILES = "doc_id long, repo string, path string, content string"


def lines(n, mark=""):
    return "\n".join(f"line {k} {mark if k == 3 else ''}" for k in range(n))


@pytest.fixture
def place(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embedder(texts):
        (calls / store.unique()).write_text(str(len(texts)))
        if any("never" in t for t in texts):
            raise OSError("down")
        return np.array([[len(t), t.count("e"), 1.0] for t in texts])

    def embedded():
        n = sum(int(f.read_text()) for f in calls.iterdir())
        for f in calls.iterdir():
            f.unlink()
        return n

    return chunkstore.ChunkStore(spark, str(tmp_path / "chunks"), embedder), embedded


def keys(own):
    return sorted((r.repo, r.path, r.start_line) for r in own.chunks().collect())


def test_only_changes_are_embedded(spark, place):
    own, embedded = place
    frame = lambda *rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], FILES)
    a, b, c = ("r", "a.py", lines(75)), ("r", "b.py", lines(10, "b")), ("q", "c.py", lines(5, "c"))
    assert own.update(frame(a, b)) == chunkstore.Update(5, 5, 0) and embedded() == 5
    assert own.update(frame(a, b)) == chunkstore.Update(0, 0, 0) and embedded() == 0
    before = keys(own)
    # one changed line touches the first chunk of a; a copy under another name has its vectors already
    changed, copy = ("r", "a.py", lines(75, "new")), ("q", "copy.py", lines(10, "b"))
    assert own.update(frame(changed, b, copy, c)) == chunkstore.Update(3, 2, 1) and embedded() == 2
    assert keys(own) == sorted([*before, ("q", "copy.py", 1), ("q", "c.py", 1)])
    assert own.update(frame(a, b)) == chunkstore.Update(1, 1, 3) and embedded() == 1  # an old text comes back
    assert keys(own) == before
    want = {(r.repo, r.path, r.start_line, r.content_hash) for r in dense.chunk_windows(frame(a, b)).collect()}
    assert {(r.repo, r.path, r.start_line, r.content_hash) for r in own.chunks().collect()} == want


def test_failures_repositories_and_compaction(spark, place):
    own, embedded = place
    rows = [(1, "r", "a.py", "one"), (2, None, "b.py", "two"), (3, "q", None, "three")]
    assert own.update(spark.createDataFrame([*rows, (4, "z", "d.py", "never " * 40)], FILES).coalesce(1)).added in (0, 3)
    own.update(spark.createDataFrame(rows, FILES))
    assert own.chunks().count() == 3 and own.remove_repo("q") == 1 and own.remove_repo("q") == 0
    assert own.chunks().count() == 2
    assert own.compact(1) and own.chunks().count() == 2 and len(own.versions()) == 1
    embedded()
    assert own.update(spark.createDataFrame(rows[:2], FILES)) == chunkstore.Update(0, 0, 0) and embedded() == 0
    assert own.update(spark.createDataFrame([], FILES)) == chunkstore.Update(0, 0, 2) and own.chunks().count() == 0


def test_second_writer_fails_and_leaves_nothing(spark, place, monkeypatch):
    own, _ = place
    own.update(spark.createDataFrame([(1, "r", "a.py", "one")], FILES))
    monkeypatch.setattr(chunkstore.ChunkStore, "versions", lambda self: [])
    with pytest.raises(RuntimeError, match="came first"):
        own._write(spark.createDataFrame([], chunkstore.CHUNKS), spark.createDataFrame([], chunkstore.CHUNKS))
    monkeypatch.undo()
    assert own.chunks().count() == 1 and not [n for n in store.names(spark, own.path) if n.startswith("tmp")]


def test_cells_of_the_store(spark, place):
    own, _ = place
    own.update(spark.createDataFrame([(k, "r", f"{k}.py", "e" * k) for k in range(1, 30)], FILES))
    ask = spark.createDataFrame([("q", [10.0, 10.0, 1.0])], "qid string, q array<double>")
    best = own.search_cells().nearest(ask, 1).best.join(chunkstore.with_id(own.chunks()), "id").first()
    assert best["path"] == "10.py"


def test_contents_are_written_once_and_meet_no_vectors(spark, place, tmp_path):
    own, embedded = place
    rows = [(1, "r", "a.py", lines(40)), (2, "r", "a.py", lines(40)), (3, None, "b.py", lines(40)), (4, None, "b.py", lines(40)), (5, "q", "c.py", "other"), (6, "q", "c.py", "another")]
    # a file given twice has its chunks once; one path with two texts has both
    assert own.update(spark.createDataFrame(rows, FILES)) == chunkstore.Update(6, 4, 0) and embedded() == 4
    assert "vector" not in spark.read.parquet(f"{own.path}/v-1/added").columns
    assert spark.read.parquet(f"{own.path}/v-1/vectors").count() == 4
    assert "Exchange" not in own.rows()._jdf.queryExecution().executedPlan().toString()
    got = {(r.repo, r.path, r.start_line, r.content): r.vector for r in own.chunks().collect()}
    assert len(got) == 6 and all(list(v) == [len(k[3]), k[3].count("e"), 1.0] for k, v in got.items())
    # the next update takes vectors of known texts, and those of texts that went stay apart from it
    assert own.update(spark.createDataFrame([*rows[:1], (7, "q", "new.py", "other")], FILES)) == chunkstore.Update(1, 0, 4)
    assert own.update(spark.createDataFrame(rows, FILES)) == chunkstore.Update(4, 1, 1) and embedded() == 1
    assert own.compact(1) and {(r.repo, r.path, r.start_line, r.content): r.vector for r in own.chunks().collect()} == got


def test_queries_do_not_go_on_without_chunks_that_could_not_be_embedded(spark, sf_dir, tmp_path, monkeypatch):
    from tracegrove.plans import retrieval_queries

    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(3).write.parquet(f"{tmp_path}/documents.parquet")

    def down(texts):
        raise OSError("down")

    monkeypatch.setattr(dense, "letter_embedder", lambda: down)
    with pytest.raises(RuntimeError, match="could not be embedded"):
        retrieval_queries.hybrid_search_lanes(spark, str(tmp_path))
