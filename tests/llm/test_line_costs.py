"""What line dedup spends on lines that are neither repeated nor in question."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lamina.llm import line_dedup as d
from lamina.llm.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_that_go_are_found_without_a_join_of_all_lines(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "d e f\na b"), (None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    gone = d.removed_lines(docs)
    assert "Join" not in plan_of(gone)
    assert sorted((r.doc_id, r.removed) for r in gone.collect()) == [(2, [0, 1])]


def test_query_reads_texts_no_more_for_the_numbers_of_lines(spark, sf_dir):
    out = QUERIES["op10_line_dedup"](spark, sf_dir)
    assert "text#" not in plan_of(out)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_lines) for r in out.collect()) == sorted((r.doc_id, (r.text or "").count("\n") + 1) for r in docs)


def test_copies_of_a_line_are_sent_once_to_where_its_words_are_worked():
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, n)], pa.int64()), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([7] * n), pa.array([8] * n)], ["doc_id", "doc_key", "line_no", "lid", "lid2"])
    one = list(d._deal_lines(iter([batch, batch]), 5))
    rows = np.concatenate([np.frombuffer(x.as_py(), dtype=d.LINE_ROW) for b in one for x in b.column(1)])
    assert (~rows["gone"]).sum() == 1 and rows[~rows["gone"]]["no_id"].all()
    assert len({x for b in one for x in b.column(0).to_pylist()}) == 5

    def found(batches):
        dealt = [b for part in batches for b in d._deal_lines(iter([part]), 1)]
        return {x for b in d._gone(iter(dealt)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}

    others = {(False, k, k, 0) for k in range(1, n)}
    assert found([batch]) == found([batch.slice(1000), batch.slice(0, 1000), batch]) == others
    named = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([d.NAMED], pa.int32()), pa.array([7]), pa.array([8])], batch.schema.names)
    assert found([batch.slice(5), named, batch]) == others | {(True, 0, 0, 0)}


def test_texts_are_lowered_as_python_does_without_decoding_them():
    chars = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [None, "", "ΑΣ ΣΑΣ\nΣ", "İx", "ß ẞ ", "ÀÉ\nÖ", "ǅ"]
    for kind in (pa.string(), pa.large_string()):
        own = pa.array(["ÄÖÜ x", *odd, *chars], kind).slice(1)
        assert [bytes(x).decode() for x in d.lowered(own)] == [(x or "").lower() for x in (*odd, *chars)]
    assert d.lowered(pa.array([], pa.string())) == [] and d.lines_of(["", "a\n\nb b"]).n_lines.tolist() == [1, 3]


def test_ranks_keep_the_order_of_counts():
    counts = np.unique(np.concatenate([np.arange(5000), np.geomspace(5000, 4e9, 300)]).astype("<u4"))
    ranks = d.rarity(counts)
    assert ranks.dtype == np.uint16 and (np.diff(ranks.astype(int)) >= 0).all() and ranks.max() < 1 << 12 and (ranks[counts <= d.RARE] == counts[counts <= d.RARE]).all()
