"""Queries against their SQL on tables with rows that the given ones lack."""

import pyarrow as pa
import pyarrow.parquet as pq

from spindrift.plans import ORACLES, QUERIES
from tests.oracle import both


def tables(folder, texts=(), conversations=()):
    n = len(texts)
    docs = {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n), "source": pa.array(["web"] * n), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(docs), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([0], pa.int64()), "quality": pa.array([1], pa.int64()), "toxic": pa.array([0], pa.int64())}), folder / "labels.parquet")
    columns = list(zip(*((c, 0, "user", "hello") for c in conversations))) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "turn", "role", "text"]), folder / "conversations.parquet")
    return str(folder)


def same(spark, name, folder):
    got, want = both(spark, QUERIES[name], ORACLES[name], folder)
    assert got == want and got[1]


def test_records_are_sorted_by_names_with_line_ends_and_without_names(spark, tmp_path):
    same(spark, "o03_record_sort", tables(tmp_path, ["Ab.\n", "ab.", None, "  b", "\ta", "", "ab.\n", "a b"]))


def test_photographs_taken_after_today_keep_their_time(spark, tmp_path):
    same(spark, "s07_photographs", tables(tmp_path, conversations=[0, 5, 51_281, 200_000, 1_000_001, 1_000_002, 1_000_003]))


def test_rows_that_the_model_has_no_vector_for_are_missing_one(spark, tmp_path):
    """Empty texts, and one whose trigrams cancel each other out; ids that are null on either side."""
    folder = tables(tmp_path, ["words of a text", "", None, "bx", " \t", "more words", "b", "last"])
    docs = pq.read_table(f"{folder}/documents.parquet")
    for known, null_row, left in (([5, 6], False, 6), ([5, 6], True, 6), ([], True, 9), ([5, None], False, 0)):
        n = len(known)
        more = pa.table({"doc_id": pa.array([None], pa.int64()), "text": ["none"], "lang": ["en"], "source": ["web"], "n_chars": pa.array([4], pa.int64())})
        pq.write_table(pa.concat_tables([docs, more]) if null_row else docs, tmp_path / "documents.parquet")
        labels = pa.array([*[1] * n, 7], pa.int64())  # a label from 5 on doesn't count
        pq.write_table(pa.table({"vec_id": pa.array([*known, 0], pa.int64()), "embedding": pa.array([[0.5, 0.5]] * (n + 1), pa.list_(pa.float32())), "label": labels}), tmp_path / "embeddings.parquet")
        got, want = both(spark, QUERIES["d06_missing_vectors"], ORACLES["d06_missing_vectors"], folder)
        assert got == want and len(got[1]) == left
