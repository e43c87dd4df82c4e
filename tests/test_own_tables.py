"""Queries of the engine against their SQL over tables made for one fault."""

import duckdb
import pytest

from lamina import queries
from lamina.operators import cakes
from lamina.oracle import SQL
from lamina.queries import QUERIES
from lamina.sources.store import Column, Store, TableConfig


def differences(spark, where, name, **tables):
    """Rows of a query that its SQL lacks, and the other way round, over tables written to a folder."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{where}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(where))
    got = sorted(map(tuple, df.collect()), key=repr)
    columns = ", ".join(df.columns)
    want = sorted(con.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=repr)
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got]


@pytest.mark.parametrize("name", ["d2_latest_first", "h10_as_of"])
def test_milliseconds_are_rounded(spark, tmp_path, name):
    micros = [-2501, -1500, -1499, -600, -500, -499, 0, 499, 500, 501, 999, 1000, 1499, 1500, 2499, 2500, 1705324408641150, 1705324408641523, 1705324408642000]
    events = spark.createDataFrame([(n, u, n % 4) for n, u in enumerate(micros)], "event_id long, us long, user_id long")
    events = events.selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) as ts", "user_id")
    assert differences(spark, tmp_path, name, events=events) == ([], [])


def test_slices_asked_of_a_layer_are_joined_by_equality(spark):
    store = Store(spark)
    layers = spark.createDataFrame([("a", None, "c", {"1": "x", "2": "y", "3": "z"}, {}), ("b", "a", "c", {"4": "w"}, {"2": "y"})], "_hash string, base string, componentsTable string, add map<string,string>, remove map<string,string>")
    store.create_table(TableConfig("oneLayer", "layers", tuple(Column(n) for n in ("base", "componentsTable", "add", "remove"))), layers)
    rows = store.table("oneLayer")
    asked = {("a", ("1",)): "1", ("a", ("2",)): "2", ("b", ("2", "3", "3", "9")): "3", ("b", ("9",)): ""}
    for wanted in (asked, {("b", ()): "134"}, asked | {("b", ()): "134", ("a", ()): "123"}, {}):
        state = spark.createDataFrame([(i, list(s)) for i, s in wanted], "id string, slices array<string>")
        links = cakes._links(store, "oneLayer", "c", rows, state)
        want = sorted((i, s, c) for (i, s), found in wanted.items() for c in found)
        assert sorted((r.parent, tuple(r.slices), r.slice) for r in links.collect()) == want
        assert all(r.own == [r.slice] and r.below == r.slices for r in links.collect())
        # not every state of a layer with every entry of it
        assert "array_contains" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_a_task_groups_lines_in_bounds_however_many_there_are(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "GROUPED", 200, raising=False)
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    out = QUERIES["c10_child_refs"](spark, sf_dir)
    held = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert n > 2000 and sum(held) == out.distinct().count() and max(held) < 600


def test_words_of_lines_that_no_pair_names_do_not_move(spark, monkeypatch):
    from lamina.llm import line_dedup

    texts = spark.createDataFrame([(n, -n, b"w") for n in range(50)], "lid long, lid2 long, words binary")
    pairs = spark.createDataFrame([(3, -3, 1, -1, 2), (4, -4, 3, -3, 1), (4, -4, 1, -1, 2)], "later long, later2 long, earlier long, earlier2 long, apart int")
    own = line_dedup.texts_of(pairs, texts)
    assert own.columns == texts.columns and sorted(r.lid for r in own.collect()) == [1, 3, 4]
    monkeypatch.setattr(line_dedup, "SENT_IDS", 2)
    assert line_dedup.texts_of(pairs, texts).count() == 50


def test_keys_of_lines_are_dealt_out_in_few_bytes(monkeypatch):
    import numpy as np

    from lamina.llm import line_dedup as d

    rng = np.random.default_rng(3)
    n = 5000
    size, place = rng.integers(4, 130, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64)
    group = rng.integers(0, 40, n).astype(np.uint64)
    key = (d.mixed(group, d.M2) << np.uint64(d.KEY_SHIFT)) | place << np.uint64(d.SIZE_BITS) | size
    lid, sketch, half = (rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(3))
    half = np.where(size >= d.SPLIT, half, half & np.uint64(0xFF << d.SKETCH_BITS))
    rows = d.dealt(tuple(x.view(np.int64) for x in (key, lid, sketch, half)), 7)
    assert sum(len(x.as_py()) for x in rows.column(1)) < 25 * n
    got = [row for x in rows.column(1) for row in zip(*(c.tolist() for c in d.undealt(x.as_buffer())), strict=True)]
    low = lambda x, bits: x & np.uint64((1 << bits) - 1)
    assert sorted(got) == sorted(zip(low(key, d.DEALT_BITS).tolist(), low(lid, d.SHORT_BITS).tolist(), sketch.tolist(), half.tolist(), strict=True))
    # all rows of a key are in one part; where a part is worked some at a time its keys are flagged
    shares = [{k >> d.KEY_SHIFT for k in d.undealt(x.as_buffer())[0].tolist()} for x in rows.column(1)]
    assert sum(map(len, shares)) == len(set().union(*shares)) == len(set(group.tolist()))
    one = d.dealt(tuple(x.view(np.int64) for x in (key, lid, sketch, half)), 1)
    for held, flags in ((1 << 20, {0}), (100, {1})):
        monkeypatch.setattr(d, "HELD", held)
        out = list(d._in_order(iter([one, one])))
        assert {k >> (d.PLACE_BITS + d.SIZE_BITS) & 1 for b in out for k in b.column(0).to_pylist()} == flags and sum(b.num_rows for b in out) == 2 * n


def test_words_of_lines_too_many_to_be_sent_do_not_all_move(spark):
    import numpy as np

    from lamina.llm import line_dedup as d

    texts = ["\n".join(f"w{n} x{n} y{n} z{n}" for n in range(k, k + 5)) for k in range(0, 500, 5)]
    named = np.sort(d.lines_of(texts).ids()[0])[::50]
    marks = d.marks_of(spark.createDataFrame([(int(x) & (1 << d.SHORT_BITS) - 1,) for x in named], "lid long"))
    batch = d.pa.RecordBatch.from_arrays([d.pa.array(range(100)), d.pa.array(range(100)), d.pa.array(texts)], ["doc_id", "doc_key", "text"])
    found = [x for b in d._texts(iter([batch]), 1, None, marks) for x in b.column(0).to_pylist()]
    assert set(named.tolist()) <= set(found) and len(found) < 20


def test_symbols_that_end_words_are_pieces_of_their_own_and_old_pieces_make_room():
    import random

    import numpy as np

    from lamina.llm import pieces
    from lamina.llm.queries import BYTE_BPE, WORD_BPE

    rng = random.Random(5)
    odd = ["".join(rng.choice(list("abs Zéñ×÷ßİıΣªºµÞ$%.,'\"<=>_^`~\n\t-09̸́̈«»ŉ!?#")) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for path in (WORD_BPE, BYTE_BPE):
        memo = pieces.PieceIds(path)
        memo.pieces(["wort$$$ wort... wort!? WORT, ñandú%%%".lower()])
        assert memo.table.held <= 8
        for limit in (pieces.MEMO_LIMIT, 2500):
            memo.table = pieces.PieceTable(limit)
            for texts in (odd[:1500], odd[:200], odd[1500:], odd):
                ids, n = memo.encode(texts)
                assert all(np.array_equal(part, memo.library(x)) for part, x in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True))
    # what was found again stays
    table = pieces.PieceTable(100)
    hashes = np.arange(160, dtype=np.uint64).reshape(80, 2)
    table.add(hashes, [np.array([k, k], dtype="<u4") for k in range(80)])
    table.again[table.find(hashes[10:30])] = True
    table.make_room(60)
    at = table.find(hashes)
    assert table.held == 20 and (at >= 0).nonzero()[0].tolist() == list(range(10, 30)) and (table.pool[table.first[at[10:30]]] == np.arange(10, 30)).all()


def test_parts_of_ids_are_even_and_in_order_also_with_equal_doc_ids(spark, tmp_path):
    from lamina.llm import token_output
    from lamina.llm.queries import WORD_BPE

    docs = [(None if k % 9 == 0 else k if k % 2 else 50, f"text {k} of some words") for k in range(400)]
    token_output.write_ids(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), str(tmp_path / "ids"), WORD_BPE, end_id=2, tokens_per_part=400)
    segments = spark.read.parquet(str(tmp_path / "ids/segments")).select("part", "doc_ids", "n_tokens").orderBy("part").collect()
    total = sum(r.n_tokens for r in segments)
    assert len(segments) > 5 and max(r.n_tokens for r in segments) < total / 3
    ids = [(d is not None, d or 0) for r in segments for d in r.doc_ids]
    assert ids == sorted(ids) == sorted((d is not None, d or 0) for d, _ in docs)
    starts = sorted((r.start, r.n_tokens) for r in token_output.read_digests(spark, str(tmp_path / "ids")).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
