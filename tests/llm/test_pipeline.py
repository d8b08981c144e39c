"""The pipeline against a brute-force version of its first three stages, and invariants of the last two."""

import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as P
    from tierstone.llm.util import table, written

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"pipeline-{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    rows = [r.asDict() for r in table(spark, SF, "documents").collect()]

    def fine(t):  # too few labels here for any cutoff
        w = t.encode().split()
        seen, hit = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)

    want = [r for r in rows if fine(r["text"] or "")]
    assert sorted(r["doc_id"] for r in kept["quality_rules"]) == sorted(r["doc_id"] for r in want)
    best = {}
    for r in sorted(want, key=lambda r: (-len(r["text"]), r["doc_id"])):
        best.setdefault("".join(r["text"].translate({c: None for c in b" \t\n\x0b\x0c\r"})), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(best.values())
    sets = {}
    for r in kept["exact_dedup"]:
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in kept["ngram_jaccard_join"]) == [i for i in sorted(sets) if up[i] == i]
    copies = Counter(r["doc_id"] for r in kept["source_mixing"])
    assert set(copies) <= {r["doc_id"] for r in kept["ngram_jaccard_join"]} and max(copies.values()) <= 2
    assert Counter(r["doc_id"] for r in kept["best_fit_packing"] if r["piece"] == 0) == copies


ODD = "doc_id long, text string, lang string, source string, n_words long, kept boolean, target double, label string, root long, __size long"


def odd_rows():
    say = lambda i, n: " ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(n))
    texts = [say(i, 80) for i in range(12)] + [say(1, 80), say(2, 80).replace(" ", "\t"), say(3, 79) + " changed", None, "", " \n", "a b", " ".join(f"u{j}" for j in range(30_000))]
    rows = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, say(60, 90), "en", "s1"), rows[5], rows[5]]
    return [(*r, 7, True, 0.5, "x", 3, 4) for r in rows]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as P
    from tierstone.llm import ngram_join
    from tierstone.llm.util import written

    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(2)
    early = ngram_join.op6(docs)
    kept = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"pipeline-{name}")
        kept.append(docs.collect())
        if name != P.STAGES[-1][0]:
            assert docs.dtypes == spark.createDataFrame([], ODD).dtypes
            assert all(tuple(r)[4:] == (7, True, 0.5, "x", 3, 4) for r in kept[-1])
    long_ones = [r for r in rows if len((r[1] or "").split()) >= 50]
    assert sorted(str(r[0]) for r in kept[0]) == sorted(str(r[0]) for r in long_ones)
    assert sorted(str(r["doc_id"]) for r in kept[1]) == sorted([*map(str, range(12)), "14", "19", "None"])
    assert sorted(str(r["doc_id"]) for r in kept[2]) == sorted([*map(str, range(12)), "19", "None"])
    assert {r["doc_id"] for r in kept[3]} <= {r["doc_id"] for r in kept[2]} and max(Counter(r["doc_id"] for r in kept[3]).values()) <= 2
    assert Counter(r["doc_id"] for r in kept[4] if r["piece"] == 0) == Counter(r["doc_id"] for r in kept[3])
    # a result that was asked for before the pipeline ran can still be read
    assert early.count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as P
    from tierstone.llm.util import written

    docs = spark.createDataFrame([], ODD)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"pipeline-{name}")
        assert docs.count() == 0
