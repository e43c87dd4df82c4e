"""The stages one after another, each against a brute-force version of its decisions on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from test_operators import contamination, ids_of, removed, simhash_of

from lamina.llm.queries import BYTE_BPE
from lamina.llm.scratch import stored


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out[name] = docs
    return out


CLASHING = ["c0", "c1", "key", "id", "no_id", "lid", "removed", "gone_id", "gone_doc_id", "removed_line_nos", "hit_doc_id", "hit_key", "lamina_none", "lamina_row", "score", "fp", "root", "words"]


def test_stages_take_any_columns_and_rows(spark, sf_dir):
    """Names that stages use inside, one id on other texts, nulls, repeated rows; and no rows at all."""
    rows_ = [(1, "one text of its own that stays"), (1, "quite another matter under the same number"), (None, "a row without any number at all"), (2, None), (3, ""), (4, "more of it"), (4, "more of it")]
    docs = spark.createDataFrame([(i, t, *range(len(CLASHING))) for i, t in rows_], "doc_id long, text string, " + ", ".join(f"{c} long" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert {tuple(r[2:]) for r in got} == {tuple(range(len(CLASHING)))}
        assert {t for _, t in rows_ if t and t != "more of it"} < {r.text for r in got}, name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).collect() == []


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_stay(spark, sf_dir, kept):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]
    assert all(kept[k].columns == columns for k in ("toxicity", "line_dedup", "simhash", "decontamination"))


def test_toxic_documents_go(spark):
    larger = "/root/testdata/sf0.01"  # the smallest table has too few toxic labels to learn words from
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    left = {d for d, _ in rows(corpus_pipeline.drop_toxic(spark, docs, larger))}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    gone = {d for d, _ in rows(docs)} - left
    assert gone and sum(labels.get(d, 1) for d in gone) > 0.8 * len(gone)
    assert sum(d in left for d, toxic in labels.items() if not toxic) > 0.98 * sum(not t for t in labels.values())


def test_lines_go(kept):
    before, after = rows(kept["toxicity"]), dict(rows(kept["line_dedup"]))
    gone = {d: set(n) for d, n in removed(before)}
    assert after == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in before}


def test_one_of_each_group_stays(kept):
    before, after = rows(kept["line_dedup"]), rows(kept["simhash"])
    prints = {d: simhash_of(t) for d, t in before}
    left = {d for d, _ in after}
    for d in prints:
        if d not in left:
            near, seen = [d], {d}
            while near:
                p = prints[near.pop()]
                new = [e for e, q in prints.items() if e not in seen and (p ^ q).bit_count() <= 2]
                seen.update(new)
                near += new
            assert len(seen & left) == 1


def test_contaminated_documents_go(spark, sf_dir, kept):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {k[0]: k[5] for k in contamination(rows(kept["simhash"]), items)}
    assert {d for d, _ in rows(kept["decontamination"])} == {d for d, h in hit.items() if not h}


def test_everything_left_is_packed(spark, sf_dir, kept):
    packed = kept["packing"].collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == Counter({d: len(ids_of(BYTE_BPE, t)) + 1 for d, t in rows(kept["decontamination"])})
    assert corpus_pipeline.run(spark, sf_dir).count() == len(packed)
