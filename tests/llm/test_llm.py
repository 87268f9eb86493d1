"""Small tests of the training-data operators: odd rows, SQL, brute force, round trips, held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import components, decontaminate, language_crf, line_dedup, mixing, ngram_join, quality_crf, quality_rules, queries, span_dedup, spans, toxicity_kernel, training_order, workspace
from oracle import differences, oracle_connection

LONG = "word and more words here. " * 4000
ROWS = [(1, None, "en", "a"), (2, "", None, None), (3, "one two three", "en", "b"), (3, "one two three", "en", "b"), (None, "no id here.", "de", "b"), (4, LONG, "fr", "a"), (5, " \n\t\n", "en", "a"), (6, "a b c d e f g h i j k", "en", "a")]
EXTRA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, an empty and a very long text, repeated rows, and columns that clash with the operators' own."""
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("id", "n", "key", "score", "cell", "items", "n_words", "component", "h", "data", "slot", "label")}
    return spark.createDataFrame(ROWS, EXTRA).withColumns(clash)


OPERATORS = {
    1: lambda d, lab, ben, tmp: training_order.write_training_order(d, f"file://{tmp}", seq_len=64),
    2: lambda d, lab, ben, tmp: span_dedup.dedup_spans(d),
    3: lambda d, lab, ben, tmp: line_dedup.dedup_lines(d, min_docs=2),
    4: lambda d, lab, ben, tmp: quality_crf.score_quality(d, lab),
    5: lambda d, lab, ben, tmp: quality_rules.apply_rules(d),
    6: lambda d, lab, ben, tmp: decontaminate.scan_benchmark(d, ben),
    7: lambda d, lab, ben, tmp: toxicity_kernel.score_toxicity(d, lab),
    8: lambda d, lab, ben, tmp: language_crf.identify_language(d),
    9: lambda d, lab, ben, tmp: ngram_join.ngram_jaccard_components(d),
    10: lambda d, lab, ben, tmp: mixing.mixing_rates(d, lab),
}


@pytest.mark.parametrize("k", OPERATORS)
def test_odd_rows_and_empty_tables(spark, odd, tmp_path, k):
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (6, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, "e f g"), (None, "a b"), (8, None), (9, "")], "item_id long, text string")
    out = OPERATORS[k](odd, labels, bench, tmp_path / "a").collect()
    if k != 1:
        assert len(out) == len(ROWS)
    ODD_VALUES[k](out)
    assert OPERATORS[k](odd.limit(0), labels.limit(0), bench.limit(0), tmp_path / "b").collect() == []


def _by_id(rows, *columns):
    """Values by id; the two equal rows of id 3 must agree."""
    out = {}
    for r in rows:
        value = tuple(r[c] for c in columns)
        assert out.setdefault(r.doc_id, value) == value
    return out


def _odd_1(rows):
    slots = [r.slot for r in rows]
    assert sorted(slots) == list(range(len(rows)))
    tokens = {}
    for r in rows:
        tokens.setdefault(r.doc_id, []).append(r.n_tokens)
    assert tokens[1] == [1] and tokens[2] == [1] and len(tokens[3]) == 2 and sum(tokens[4]) > 20_000 and None in tokens


def _odd_2(rows):
    got = _by_id(rows, "n_sentences", "n_removed")
    assert (got[1], got[2], got[3], got[5], got[None]) == ((0, 0), (0, 0), (1, 0), (0, 0), (1, 0)) and got[4] == (4000, 3999)  # of equal sentences in a row all but the first lie in a span that is not the first


def _odd_3(rows):
    # the two rows of id 3 are one document, so no line is in two documents
    assert all(r.n_dropped == 0 for r in rows) and _by_id(rows, "n_lines")[5] == (3,) and _by_id(rows, "text")[1] == ("",)


def _odd_scores(rows):
    got = _by_id(rows, "score", "held_out")
    assert all(0 <= s <= 1 for s, _ in got.values()) and got[1] == (got[2][0], got[1][1]) and got[None][1] is False


def _odd_5(rows):
    got = _by_id(rows, "n_words", "base_failed", "kept")
    assert got[1] == got[2] == got[5] == (0, True, False) and got[6] == (11, False, True) and got[4][:2] == (20_000, True)


def _odd_6(rows):
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows}
    assert got[6] == (11, 3, ["7"]) and got[1] == got[2] == got[5] == (0, 0, [])


def _odd_8(rows):
    got = _by_id(rows, "lang_pred", "score")
    assert got[1] == got[2] == got[5] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())


def _odd_9(rows):
    got = _by_id(rows, "n_shingles", "component_id")
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[5] == (0, 5) and got[None] == (1, None) and got[4] == (5, 4)


def _odd_10(rows):
    got = _by_id(rows, "n_tokens", "rate", "copies")
    assert got[1][0] == got[2][0] == got[5][0] == 0 and got[4][0] == 20_000 and all(r >= 0 and c in (int(r), int(r) + 1) for _, r, c in got.values())


ODD_VALUES = {1: _odd_1, 2: _odd_2, 3: _odd_3, 4: _odd_scores, 5: _odd_5, 6: _odd_6, 7: _odd_scores, 8: _odd_8, 9: _odd_9, 10: _odd_10}


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts and empty tables go through every stage; clashing columns come out as they went in."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([(3, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in ROWS], EXTRA + ", n_chars int").withColumns({c: F.lit("x") for c in ("id", "row", "rows", "score", "copies", "key hash")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r["row"] == "x" and r["id"] == "x" for r in kept), name
        if name == "n-gram Jaccard join":
            assert len(kept) == len(ROWS)
        if name == "benchmark decontamination":
            assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in ROWS if r[0] != 6)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    assert differences(spark, oracle_connection(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf) == ""


def test_decontaminate_in_blocks_and_cut(spark):
    docs = spark.createDataFrame([(1, "x. Alpha beta gamma; y"), (2, None), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "y"), (4, "Y"), (None, "nothing")], "item_id long, text string")
    for chars in (5, 1000):
        r, empty, clean = sorted(decontaminate.scan_benchmark(docs, bench, cut=True, block_chars=chars).collect(), key=lambda r: r.doc_id)
        assert (r.n_words, r.n_hit, r["items"], r.text) == (5, 4, ["1", "2", "3", "4"], "x. ")
        assert (empty.n_words, empty.text, clean.n_hit, clean.text) == (0, None, 0, "nothing")


def test_decontaminate_in_blocks_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(40)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(30)]
    got = decontaminate.scan_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), width=6, block_chars=60).collect()
    for r in got:
        w = dict(docs)[r.doc_id].split()
        hit, found = set(), set()
        for i, t in items:
            v = t.split()
            size = min(6, len(v))
            for a in range(len(v) - size + 1):
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == v[a : a + size]:
                        hit |= set(range(b, b + size))
                        found.add(str(i))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))


def test_line_dedup_keeps_first(spark):
    docs = spark.createDataFrame([(2, "Same\nb"), (1, "a\n same "), (3, "same\nsame")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=2, keep="first").collect()}
    assert got == {1: ("a\n same ", 0), 2: ("b", 1), 3: ("", 2)}


def _spans_by_hand(docs, k, w, long):
    """Every run of k sentences, shorter runs of `long` words, and short texts of w words; the first of equal runs stays."""
    import re

    cut, first, runs = {}, {}, []
    for i, t in sorted(docs):
        cut[i] = [s.lower().split() for s in re.findall(r"(?:[^.!?\n]|[.!?](?!\s|$))+(?:[.!?\n]|$)", t) if s.strip(" .!?\n")]
        for size in range(1, k + 1):
            for a in range(len(cut[i]) - size + 1):
                words = [x for s in cut[i][a : a + size] for x in s]
                if size == k or len(words) >= long or (len(cut[i]) == size and len(words) >= w):
                    runs.append((tuple(words), i, a, size))
    for key, i, a, _ in sorted(runs, key=lambda r: r[1:3]):
        first.setdefault(key, (i, a))
    gone = {i: set() for i in cut}
    for key, i, a, size in runs:
        if first[key] != (i, a):
            gone[i] |= set(range(a, a + size))
    return {i: (len(cut[i]), len(gone[i])) for i in cut}


@pytest.mark.parametrize("seed", [4, 5])
def test_span_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", "?\n", ".\n"]) for _ in range(30)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string"), min_sentences=3, min_words=6, long_words=12).collect()}
    assert got == _spans_by_hand(docs, 3, 6, 12)


def test_span_dedup_of_short_runs_and_repeated_ids(spark):
    run = "It was so. We saw it. They left then."
    a, b = "The first text says this here. And then more of it follows. It ends.", "Wholly other words are in this one. Nothing of it is seen before. Its end."
    docs = [(1, a), (2, a), (2, b), (3, f"{run} The rest of three."), (4, f"Four has a start 10.0.0.1 here. {run}"), (None, "x y z"), (5, None), (6, "")]
    got = {(r.doc_id, r.text): r.n_removed for r in span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, a): 0, (2, ""): 3, (2, b): 0, (3, f"{run} The rest of three."): 0, (4, "Four has a start 10.0.0.1 here."): 3, (None, "x y z"): 0, (5, ""): 0, (6, ""): 0}


def test_near_copies_of_many_documents(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 6])):
            words[rng.randrange(120)] = f"x{i}-{rng.random()}"
        docs.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(117)} for i, t in docs}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}


def _stacked_workers(plan: str) -> bool:
    """Whether a task of the plan runs one Python worker on what another gives."""
    path: list[tuple[int, str]] = []
    for line in plan.splitlines():
        depth = re.match(r"[ :+-]*", line).end()
        path = [x for x in path if x[0] < depth] + [(depth, line[depth:])]
        inside = itertools.takewhile(lambda name: "Exchange" not in name, (name for _, name in reversed(path)))
        if path[-1][1].startswith("MapInArrow") and sum(name.startswith("MapInArrow") for name in inside) > 1:
            return True
    return False


def test_near_copies_take_one_worker_a_task_and_short_filters(spark, monkeypatch):
    plans, kinds, write = {}, {}, workspace.materialise

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        kinds.update(df.dtypes)
        return write(df, label)

    monkeypatch.setattr(workspace, "materialise", noted)
    text = " ".join(f"w{i}" for i in range(100))
    docs = [(1, text), (2, f"{text} x"), (3, f"y {text}"), (4, " ".join(f"w{i}" for i in range(50))), (5, "else")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert "reach" in plans and kinds["p2"] == kinds["p3"] == "array<int>"
    assert not [label for label, made in plans.items() if any(map(_stacked_workers, made))]


def _components_by_hand(docs, width, percent):
    sets = {i: {tuple(t.split()[j : j + width]) for j in range(max(1, len(t.split()) - width + 1))} for i, t in docs}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def test_links_of_unequal_sizes_around_third_documents(spark):
    """Each text and its longer copy meet only at shingles whose centre is a third document."""

    def ranks(shingles):
        h, _ = ngram_join.shingle_sets(*spans.text_buffers(pa.array(shingles)), 4)
        return [spans.mix(h ^ seed) for seed in ngram_join.SEEDS[:2]]

    docs = []
    for g in range(12):
        longer = [f"a{g}-{k}" for k in range(103)] + [f"b{g}-{k}" for k in range(16)]
        docs += [(100 * g, " ".join(longer[:103])), (100 * g + 1, " ".join(longer))]
        shingles = [" ".join(longer[j : j + 4]) for j in range(116)]
        for k, j in enumerate(np.argsort(ranks(shingles)[0])[:18]):
            # the third document is first known by the shared shingle, and second by one that a fourth document has
            for x in range(1000):
                other = " ".join([*longer[j + 1 : j + 4], f"x{g}-{x}"])
                first, second = ranks([shingles[j], other])
                if first[0] < first[1] and second[1] < second[0]:
                    break
            docs += [(100 * g + 2 + 2 * k, f"{shingles[j]} x{g}-{x}"), (100 * g + 3 + 2 * k, other)]
    want = _components_by_hand(docs, 4, 85)
    assert all(want[100 * g + 1] == 100 * g for g in range(12))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), width=4, percent=85).collect()}
    assert got == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_permutation(n):
    p = training_order.Permutation(n, 9)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert p.numbers(slots).tolist() == list(range(n))


def test_training_order_round_trip(spark, tmp_path):
    docs = [(i, f"text number {i} " * (i % 50)) for i in range(200)]
    index = training_order.write_training_order(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}", seq_len=32, rows_per_shard=100).collect()
    records = list(training_order.read_slots(f"file://{tmp_path}", 0, 10**9))
    assert len(records) == len(index) and sorted(r.slot for r in index) == list(range(len(index)))
    with open(training_order.vocabulary_path(), "rb") as f:
        encoder = training_order.Encoder(f.read())
    parts: dict = {}
    for r in sorted(index, key=lambda r: (r.doc_id, r.seq)):
        parts.setdefault(r.doc_id, []).extend(records[r.slot][: r.n_tokens].tolist())
    assert {i: encoder.core.decode(ids[:-1]) for i, ids in parts.items()} == dict(docs)
    assert [x.tolist() for x in training_order.read_slots(f"file://{tmp_path}", 95, 105)] == [x.tolist() for x in records[95:105]]


def test_encoding_in_pieces_is_plain_encoding():
    with open(training_order.vocabulary_path(), "rb") as f:
        encoder = training_order.Encoder(f.read())
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \n\t'sab1.é\u3000\xa0\x1c,-😀Z") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    odd += [None, "", " ", "a", "a b", "longer-than-sixteen-bytes " * 9, "same words same words"]
    data, at = spans.text_buffers(pa.array(odd))
    ids, counts = encoder.encode(data, at)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.core.encode_ordinary(t or "") for t in odd]
    assert encoder.encode(data, at, count_only=True)[1].tolist() == counts.tolist()
    assert encoder.encode(*spans.text_buffers(pa.array([None, ""], pa.string())))[1].tolist() == [0, 0]


def _held(spark, sf, name, label):
    import __spark_entry__  # noqa: F401

    return queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label).collect()


def test_quality_on_held_out(spark):
    rows = _held(spark, "/root/testdata/sf0.1", "op4_quality_classifier", "quality")
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_toxicity_on_held_out(spark):
    """On the given tables, whose marks in three languages are built of common syllables, some clean texts are taken for toxic; see README."""
    rows = _held(spark, "/root/testdata/sf0.1", "op7_toxicity", "toxic")
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.08


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, sf).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_language_undetermined(spark):
    model = language_crf.fit([("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")] * 4)
    docs = pa.array(["12 34", "the dog", "der hund"])
    data, at = spans.text_buffers(docs)
    f = language_crf.WordFeatures(data, at)
    best, _ = model.label(model.emissions(f), f.size.astype(np.float32), f.first)
    assert [model.langs[b] if b >= 0 else "und" for b in best] == ["und", "en", "de"]


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    words = {"es": ["el", "perro", "y", "casa"], "de": ["der", "hund", "und", "haus"]}
    docs = []
    for i in range(400):
        lang = "es" if i % 4 else "de"
        docs.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 30))), lang))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rates = mixing.mixing_rates(frame, frame, {"es": 0.5, "de": 0.5}).join(frame.select("doc_id", "lang"), "doc_id").collect()
    held = {x: sum(r.rate * r.n_tokens for r in rates if r.lang == x) for x in ("es", "de")}
    total = sum(r.n_tokens for r in rates)
    assert total == sum(len(t.split()) for _, t, _ in docs)
    assert all(abs(v - total / 2) < 0.02 * total for v in held.values())
    again = mixing.apply_mix(frame, frame, {"es": 0.5, "de": 0.5})
    assert again.columns == frame.columns and again.count() == sum(r.copies for r in rates)


@pytest.mark.parametrize("seed", range(3))
def test_projection_is_nonnegative_least_squares(spark, seed):
    """Targets in and out of reach, against coordinate descent in numpy."""
    rng = np.random.default_rng(seed)
    k, n = 2 + seed, 8
    post = rng.dirichlet(np.full(k, 0.4), n)
    tokens = rng.integers(1, 1000, n)
    m = post * tokens[:, None]
    goal = rng.dirichlet(np.full(k, 0.3)) * tokens.sum()
    r = np.ones(n)
    for _ in range(4000):
        for c in range(n):
            r[c] = max(0.0, r[c] - m[c] @ (r @ m - goal) / (m[c] @ m[c]))
    cells = spark.createDataFrame([(str(c), int(tokens[c]), *map(float, m[c])) for c in range(n)], "cell string, tokens long, " + ", ".join(f"m{i} double" for i in range(k)))
    got = mixing._project(cells.coalesce(1), goal.tolist(), float(m.sum(axis=0).max()), 1.0, 300, 1e-6)
    rate = np.array([x.rate for x in sorted(got.collect(), key=lambda x: int(x.cell))])
    assert (rate >= 0).all()
    assert np.linalg.norm(rate @ m - goal) <= np.linalg.norm(r @ m - goal) + 1e-3 * tokens.sum()


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = workspace.table(spark, sf, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = workspace.materialise(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    index = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert index.select("slot").distinct().count() == index.count() >= sizes[4]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_pipeline_stages_hand_out_few_rows_at_once(spark, tmp_path, k):
    """Also while a caller writes what a stage returned."""
    import corpus_pipeline

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word', id, ' and more of it') as text").coalesce(1)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        sizes = out.sparkSession.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= workspace.BATCH_ROWS
    finally:
        spark.conf.set(setting, before)


def test_pipeline_drops_a_copy_with_an_appended_block(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(124)]  # 100 of 120 shingles of five words are shared, 101 of 121 of four
    docs = spark.createDataFrame([(1, " ".join(words[:104])), (2, " ".join(words)), (3, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_pipeline_cuts_leaks_from_long_documents(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(60))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = [f"w{i}" for i in range(1300)]
    docs = [(1, f"{' '.join(long[:700])} {item} {' '.join(long[700:])}", "en", 5), (2, item, "en", 5), (3, "clean text", None, 10), (None, None, None, None), (None, item, None, 5), (2, "another text of that id", "en", 23)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars int")
    got = corpus_pipeline.leaks(spark, frame, str(tmp_path))
    kept = f"{' '.join(long[:700])}  {' '.join(long[700:])}"
    assert got.schema == frame.schema
    assert {tuple(r) for r in got.collect()} == {(1, kept, "en", len(kept)), docs[2], docs[3], docs[5]}


@pytest.mark.parametrize("score", [quality_crf.score_quality, toxicity_kernel.score_toxicity])
def test_samples_are_drawn_from_short_enough_texts(spark, score):
    long = "some words of a long text. " * 1500
    docs = [(i, long if i % 20 else f"{'good' if i % 40 else 'awful'} words in number {i} of the short texts.") for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 < 20), int(i % 40 < 20)) for i in range(400)], "doc_id long, quality int, toxic int")
    if score is quality_crf.score_quality:
        assert len({r.score for r in score(frame, labels, per_class=2).collect()}) > 1
    with pytest.raises(ValueError):
        score(frame.where("doc_id % 40 <> 0"), labels)


def test_quality_fit_holds_features_not_work_arrays_of_its_whole_sample():
    """The driver's memory while it fits: a few times a run of texts and the lines' features, whatever the sample's size."""
    import tracemalloc

    rng = random.Random(5)
    examples = [("\n".join(" ".join(rng.choice(["plain", "WORDS", "12", "#|", "end."]) for _ in range(60)) for _ in range(60)), k % 2) for k in range(400)]
    quality_crf.fit(examples[:2])  # tables of powers are made once
    tracemalloc.start()
    try:
        quality_crf.fit(examples)
        assert tracemalloc.get_traced_memory()[1] < 15 * sum(len(t) for t, _ in examples)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_quality_features_by_runs_are_those_of_all_texts(limit):
    texts = ["one two two\n\none two two\nEnd.", "", None, "\n", "é ü | # $ 12\nfoot", "the same\nthe same", "no end"]
    data, at = spans.text_buffers(pa.array(texts))
    for ours, whole in zip(quality_crf.sample_features(texts, limit), quality_crf.line_features(data, at), strict=True):
        assert ours.dtype == whole.dtype and np.array_equal(ours, whole)
    assert quality_crf.sample_features([], limit)[2].tolist() == [0]
