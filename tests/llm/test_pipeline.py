"""The stages of the pipeline in turn, each against what the brute-force tests of its operator say."""

import collections
import re

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    good = [" ".join(words[(i * 7 + k * k) % 10] + str((i * k) % 23) for k in range(60)) + "." for i in range(80)]
    texts = {i: good[i] for i in range(80)}
    texts |= {100 + i: good[i].replace(" ", "  ") for i in range(10)}
    texts |= {200 + i: good[i + 20].replace("alpha0", "changed", 1) for i in range(10)}
    texts |= {300 + i: " | ".join("#$%" for _ in range(40 + i)) for i in range(60)}
    texts |= {400: None, 401: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in texts if i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    from tests.llm.test_operators import sets_and_components, windows_removed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    kept = stages["quality classifier"](spark, docs, sf_dir).cache()
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and ids >= set(range(80)) and not ids & set(range(300, 360))
    unique = stages["exact dedup"](spark, kept, sf_dir).cache()
    groups = collections.defaultdict(list)
    for r in kept.collect():
        groups[re.sub("[\x20\x09-\x0d]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == {min(g)[1] for g in groups.values()}
    apart = stages["n-gram Jaccard join"](spark, unique, sf_dir).cache()
    _, labels = sets_and_components([(r["doc_id"], r["text"]) for r in unique.collect()])
    assert apart.columns == docs.columns and {r["doc_id"] for r in apart.collect()} == {i for i, label in labels.items() if i == label}
    short = stages["suffix-array dedup"](spark, apart, sf_dir).cache()
    want = {i: bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode() for i, (raw, gone) in windows_removed([(r["doc_id"], r["text"]) for r in apart.collect()]).items()}
    assert short.columns == docs.columns and {r["doc_id"]: r["text"] for r in short.collect()} == want
    packed = stages["best-fit packing"](spark, short, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(want)
    assert pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_of_awkward_tables(spark, sf_dir):
    """Null and shared doc_ids, repeated rows, names that clash or hold dots, empty tables: every stage keeps its columns."""
    import random

    rng = random.Random(3)
    alpha, beta = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60)) for _ in range(2))
    schema = "doc_id long, text string, _score double, `a.b` string, sha string, key string, lost string, rest string, n_chars int"
    rows = [(1, alpha), (5, beta), (5, alpha), (5, beta + "  "), (5, beta), (None, alpha), (None, "own text of a row without an id"), (8, None), (8, ""), (9, beta + " end")]
    docs = spark.createDataFrame([(i, t, 0.1, "dot", None, None, "lost", None, len(t or "")) for i, t in rows], schema).repartition(3)
    stages = dict(pipeline.STAGES)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and out.where("`a.b` = 'dot'").count() == out.count()
        assert stages[name](spark, docs.where("false"), sf_dir).count() == 0
    unique = sorted(((r["doc_id"] or 0, r["text"]) for r in stages["exact dedup"](spark, docs, sf_dir).collect()), key=str)
    assert len(unique) == 5 and {t for _, t in unique} - {"", None} == {alpha, beta + "  ", "own text of a row without an id", beta + " end"}
    near = [(r["doc_id"], r["text"]) for r in stages["n-gram Jaccard join"](spark, docs, sf_dir).collect()]
    assert sorted(i or 0 for i, _ in near) == [0, 0, 1, 8, 8]
    short = [(r["doc_id"], r["text"], r["n_chars"]) for r in stages["suffix-array dedup"](spark, docs, sf_dir).collect()]
    assert len(short) == len(rows) and all(n == len(t or "") for _, t, n in short) and [t for i, t, _ in short if i is None and t.startswith("own")]
    assert stages["best-fit packing"](spark, docs, sf_dir).groupBy("doc_id").count().count() == 5
