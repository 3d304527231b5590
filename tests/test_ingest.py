"""Tables that change together, and ingestion that stops between two of them."""

import hashlib

import pytest
from pyspark.errors import StreamingQueryException

from kgspark.operators.chunking import ChunkSettings
from kgspark.sources.tables import TableStore
from kgspark.streaming import ingest

SHORT = ChunkSettings(least=1)
FILES = {"a.md": "Alpha met Beta. Beta saw Gamma.", "b.md": "Gamma left Delta. Alpha met Delta.", "c.md": "Omega knows Sigma. Sigma met Omega."}


def rows_of(store):
    return {name: sorted(map(tuple, store.read(name).collect()), key=repr) for name in ingest.SCHEMAS}


def batch(spark, texts):
    return spark.createDataFrame([(k, f"/{k}", t, hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()], "id string, path string, text string, content_hash string")


class Stopping(TableStore):
    """Dies before it writes the table of the given place."""

    left = 3

    def _write(self, name, rows, number):
        if self.left == 0:
            raise OSError("killed between two tables")
        self.left -= 1
        super()._write(name, rows, number)


def test_stream_stopped_between_two_tables_equals_one_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_text(text)
    broken = Stopping(spark, f"file://{tmp_path}/store", ingest.SCHEMAS)
    with pytest.raises(StreamingQueryException):
        ingest.ingest_folder(str(folder), broken, f"{tmp_path}/cp", ingest.Ingest(broken, settings=SHORT)).awaitTermination()
    assert broken.commits() == [] and all(not v for v in rows_of(broken).values())
    store = TableStore(spark, f"file://{tmp_path}/store", ingest.SCHEMAS)
    ingest.ingest_folder(str(folder), store, f"{tmp_path}/cp", ingest.Ingest(store, settings=SHORT)).awaitTermination()
    whole = TableStore(spark, f"file://{tmp_path}/whole", ingest.SCHEMAS)
    ingest.ingest_folder(str(folder), whole, f"{tmp_path}/cp2", ingest.Ingest(whole, settings=SHORT)).awaitTermination()
    got = rows_of(store)
    assert got == rows_of(whole) and len(got["documents"]) == 3
    counts = {r[1]: r[5] for r in got["entities"]}
    assert counts == {"Alpha": 2, "Beta": 1, "Gamma": 2, "Delta": 1, "Omega": 1, "Sigma": 1}
    assert {r[0] for r in got["membership"]} == {r[0] for r in got["entities"]}


def test_changed_documents_replace_what_they_gave(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s", ingest.SCHEMAS)
    run = ingest.Ingest(store, settings=SHORT)
    run(batch(spark, FILES), 0)
    before = rows_of(store)
    run(batch(spark, FILES), 1)
    assert rows_of(store) == before and store.state()["batch"] == 1
    run(batch(spark, {"b.md": "Kappa met Alpha."}), 2)
    run(batch(spark, {"b.md": "never seen"}), 2)
    got = rows_of(store)
    assert {r[1]: r[5] for r in got["entities"]} == {"Alpha": 2, "Beta": 1, "Gamma": 1, "Omega": 1, "Sigma": 1, "Kappa": 1}
    assert {r[0]: r[3] for r in got["documents"]} == {"a.md": 1, "b.md": 2, "c.md": 1}
    names = {r[0]: r[1] for r in got["entities"]}
    own = {names[i]: c for i, c in got["membership"]}
    was = {r[1]: dict(before["membership"])[r[0]] for r in before["entities"]}
    assert own["Omega"] == was["Omega"] == own["Sigma"] and own["Kappa"] == own["Alpha"]
    store.expire(1)
    assert rows_of(store) == got and len(store.commits()) == 1
    run(batch(spark, {}), 3)
    assert rows_of(store) == got
