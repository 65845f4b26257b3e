"""The pipeline, stage by stage, against brute force over each stage's own input."""

import collections
import random

import pytest

import corpus_pipeline
from trigrove.llm import compression, containment, decontam

from .test_operators import brute_compression, brute_leaks, brute_near, brute_pack, messy, prose, table, words_of


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(k, prose(rng, 25)) for k in range(6)]
    rows = messy(rng) + [(40, "Ating. " * 400)]
    pool = [prose(rng, 12) for _ in range(10)]
    for k in range(60):
        body = "\n".join([prose(rng, rng.randint(20, 120)) for _ in range(3)] + ([rng.choice(pool)] if k % 3 == 0 else []))
        rows.append((100 + k, body))
        if k % 6 == 0:
            rows.append((200 + k, body))  # an exact copy
        if k % 6 == 1:
            w = body.split(" ")
            w[len(w) // 2] = "edited"
            w[len(w) // 5] = "edited"
            w[-3] = "edited"
            rows.append((300 + k, " ".join(w)))
        if k % 10 == 2:
            rows.append((400 + k, body[: len(body) // 3] + "\n" + items[k // 10][1]))
    folder = str(tmp_path_factory.mktemp("sf"))
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def ident(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = original = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in docs.collect()]
        if name == "pack":
            want = {}
            for r in before:
                if r["doc_id"] is not None and words_of(r["text"]):
                    want[r["doc_id"]] = max(want.get(r["doc_id"], 0), len(words_of(r["text"])))
            bins, rest = [], []
            for i, n in sorted(want.items()):
                bins += [([i], [k * 2048], [2048]) for k in range(n // 2048)]
                if n % 2048:
                    rest.append((i, n // 2048 * 2048, n % 2048))
            bins += [tuple([rest[j][k] for j in b] for k in range(3)) for b in brute_pack([n for _, _, n in rest], 2048)]
            assert sorted((r["doc_ids"], r["begins"], r["lengths"]) for r in after) == sorted(bins)
            break
        assert docs.columns == columns
        if name == "quality_rules":
            rules = compression.CompressionRules()
            assert ident(after) == ident(r for r in before if brute_compression(r["text"], rules)[4] == "keep")
            assert 40 not in {r["doc_id"] for r in after}
        if name == "line_dedup":
            seen, first = set(), {}
            for r in sorted((r for r in before if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
                for p, x in enumerate([] if r["text"] is None else r["text"].split("\n")):
                    if len(x) >= 20 and x not in seen:
                        seen.add(x)
                        first[x] = (r["doc_id"], p)
            want = []
            for r in before:
                if r["doc_id"] is None or r["text"] is None:
                    want.append(r)
                    continue
                all_lines = r["text"].split("\n")
                left = [x for p, x in enumerate(all_lines) if len(x) < 20 or first[x] == (r["doc_id"], p)]
                if len(left) == len(all_lines) or any(x.strip() for x in left):
                    want.append({**r, "text": "\n".join(left)})
            assert ident(after) == ident(want)
            assert all(r["n_chars"] == len(r["text"] or "") for r in after)
            assert not {i for i in {r["doc_id"] for r in after if r["doc_id"] is not None} if 200 <= i < 300}
        if name == "near_dedup":
            classes, _ = brute_near([(r["doc_id"], r["text"]) for r in original], containment.ContainmentRules())
            ids = {r["doc_id"] for r in before if r["doc_id"] is not None}
            least = {}
            for i in sorted(ids):
                if i in classes:
                    least.setdefault(classes[i][0], i)
            left = {i for i in ids if i not in classes or least[classes[i][0]] == i}
            assert {r["doc_id"] for r in after if r["doc_id"] is not None} == left
            assert sum(1 for r in after if r["doc_id"] is None) == sum(1 for r in before if r["doc_id"] is None)
            assert not any(300 <= i < 400 for i in left)
        if name == "decontaminate":
            leaks = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], items, decontam.DecontamRules())}
            assert {r["doc_id"] for r in after if r["doc_id"] is not None} == {r["doc_id"] for r in before if r["doc_id"] is not None} - leaks
            assert len([i for i in leaks if 400 <= i < 500]) == 6
        before = after


def test_near_dedup_follows_what_earlier_stages_took_out(spark, tmp_path):
    w = prose(random.Random(3), 150).split(" ")
    rows = [(1, " ".join(w[:100])), (2, " ".join(w[25:125])), (3, " ".join(w[50:]))]  # 2 is linked to both others, which aren't linked
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect())
    assert ids(docs) == [1]
    assert ids(docs.where("doc_id <> 2")) == [1, 3]


def test_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
