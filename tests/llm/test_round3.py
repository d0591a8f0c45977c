"""The filter audit, fill-in-middle and substring deduplication against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import differences, oracle
from conftest import SF
from ledgerloom.llm import fill_in_middle, filter_audit, hash_tables, registry, substring_dedup, toxicity
from test_llm import empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_fill_in_middle", "op13_substring_dedup"])
def test_same_as_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF).toPandas(), oracle(registry.SQL[name], SF)) == ""


# --- filter audit -----------------------------------------------------------------------------------------------------


def audit_by_force(rows, labels):
    """Every document through every order, one at a time."""
    fails, out = [], defaultdict(lambda: [0] * 6)
    for i, text, part in rows:
        words = WORD.findall(text or "")
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text or "")) > 2 * len(text or ""),
               "D": bool(re.search("[#$%&*|]", text or "")), "E": any(j is not None and i is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)}
        fails.append((i, part or "", own))
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        for i, part, own in fails:
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                row[3] += own[f] and sum(own.values()) == 1
                row[2] += own[f] and gone
                if own[f] and not gone:
                    gone = True
                    row[1] += 1
                    row[4] += labels.get(i, (0, 0))[0] == 1
                    row[5] += labels.get(i, (0, 0))[1] == 1
                    shapley[part, f] += 1
                row[0] += not gone
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame([(i, *m) for i, m in labels.items()], "doc_id long, quality int, toxic int")
    got = filter_audit.interaction_audit(docs, marks).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_filter_audit_against_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)] + ["Ab", "CD", "#x", "é|", " "]
    rows = [(i, " \t\n\x0b\x0c\r"[rng.randrange(6)].join(rng.choices(words[rng.randrange(100):], k=rng.choice([1, 50, 199, 200, 201, 400]))), rng.choice(["a", "b", "", None])) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 20, 3)] + [(7, rows[7][1], rows[7][2])] * 2  # copies, and a row three times
    rows += [(200, None, None), (201, "", ""), (202, "  \n", "a"), (None, "x", "a"), (None, "x", "a"), (203, "x", "a"), (204, "x\x85y z " * 120, "b")]
    labels = {i: (i % 2, i % 3 == 0) for i in range(0, 204, 2)} | {203: (None, 1)}
    labels = {i: (q, int(t)) for i, (q, t) in labels.items()}
    assert audited(spark, rows, labels) == audit_by_force(rows, labels)


def test_filter_audit_odd(spark):
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.interaction_audit(odd_documents(spark), labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert [(r.part, r.kept + r.removed, r.good_lost, r.toxic_lost) for r in got] == [("", 13, 1, 1)]
    assert filter_audit.interaction_audit(empty(odd_documents(spark)), labels).count() == 0


# --- fill-in-middle ---------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZb .\n1é中🙂<", max_size=40))
def test_runs_find_every_unit(text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    runs = fill_in_middle.Runs(text)
    assert runs.units == len(units)
    assert [runs.character(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def middle_by_force(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    output = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), output


def test_fill_in_middle_against_force(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcXYZ <>PSM\n.é中🙂\x00", k=rng.randrange(60)))) for i in range(400)]
    rows += [(1000, "x <P> y"), (1001, "<S>"), (1002, "<M>"), (1003, "a" * 100_000), (1004, "." * 100_000), (1005, "< P>S>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(docs)
    got = {r.doc_id: r for r in made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_force(i, text), i
        assert r.back == text
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd(spark):
    got = fill_in_middle.fill_in_middle(odd_documents(spark))
    source = Counter((r.doc_id, r.text or "") for r in odd_documents(spark).collect())
    assert Counter((r.doc_id, r.back) for r in got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()) == source
    assert fill_in_middle.fill_in_middle(empty(odd_documents(spark))).count() == 0


# --- substring dedup --------------------------------------------------------------------------------------------------


def removed_by_force(rows, window):
    """Every window of every document, in order of their ids, against all windows before it."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text)
        covered = [False] * len(words)
        for s in range(len(words) - window + 1):
            own = tuple(words[s : s + window])
            if own in seen:
                covered[s : s + window] = [True] * window
            seen.add(own)
        out[i] = len(words), sum(covered), " ".join(w for w, c in zip(words, covered, strict=True) if not c), covered
    return out


def passages(seed, n, vocabulary, window):
    """Texts of pieces shared in whole or in part, of runs of one word, and of words of few kinds."""
    rng = random.Random(seed)
    draw = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [draw(rng.randrange(window // 2, 4 * window)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            piece = rng.choice(shared)
            a = rng.randrange(len(piece))
            kind = rng.randrange(4)
            words += piece if kind == 0 else piece[a:] if kind == 1 else draw(rng.randrange(2 * window)) if kind == 2 else ["same"] * rng.randrange(3 * window)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("window", "anchor", "kinds"), [(20, 10, 5000), (20, 10, 2), (6, 3, 3), (4, 4, 3), (5, 1, 6)])
def test_substring_dedup_against_force(spark, window, anchor, kinds, monkeypatch):
    rows = passages(window + kinds, 120, [f"w{i}" for i in range(kinds)], window)
    want = removed_by_force(rows, window)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, anchor=anchor).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, removed, kept, covered = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, kept), r.doc_id
        spans = [(m.start(), len(m[0])) for m in re.finditer("x+", "".join("x" if c else "." for c in covered))]
        assert [(s.start, s.words) for s in r.repeats] == spans


def test_substring_dedup_cuts_long_texts():
    """Segments and chunks give each window once, whatever their size."""
    text = " ".join(random.Random(1).choices([f"w{i}" for i in range(50)], k=5000))
    reader = substring_dedup.Reader(20)
    whole = reader.hashes(text)
    old = substring_dedup.MOST, substring_dedup.CHUNK
    try:
        substring_dedup.MOST, substring_dedup.CHUNK = 700, 300
        assert (substring_dedup.Reader(20).hashes(text) == whole).all()
        parts = list(substring_dedup.Reader(20).parts(["short", text, "", text]))
    finally:
        substring_dedup.MOST, substring_dedup.CHUNK = old
    starts = Counter()
    for part in parts:
        for row, first, begin, end in zip(part.row, part.first, part.begins, part.ends, strict=True):
            assert (part.words[begin:end] == whole[first : first + end - begin]).all()
            starts.update((row, first + k) for k in range(end - begin - 19))
    assert starts == Counter({(row, k): 1 for row in (1, 3) for k in range(4981)})


def test_substring_dedup_odd(spark):
    got = substring_dedup.substring_dedup(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 13 and (by_id[1].n_words, by_id[1].kept, by_id[8].n_words) == (0, "", 0)
    assert (by_id[6].n_removed, by_id[7].n_words - by_id[7].n_removed, by_id[7].kept) == (0, 1, "end")
    assert substring_dedup.substring_dedup(empty(odd_documents(spark))).count() == 0
    long = " ".join(f"w{i}" for i in range(40))
    repeated = spark.createDataFrame([(5, long), (5, long), (5, long + " tail"), (None, long), (9, long)], "doc_id long, text string")
    rows = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(repeated).collect()]
    assert sorted(rows, key=repr) == sorted([(5, 40, 40), (5, 40, 40), (5, 41, 40), (None, 40, 0), (9, 40, 40)], key=repr)


# --- tables of hashes -------------------------------------------------------------------------------------------------


def test_tables_that_are_lost_or_not_shared(spark, monkeypatch):
    rng = np.random.default_rng(1)
    store, shards = hash_tables.Store(spark, "test"), 700
    keys = np.unique(rng.integers(0, 1 << 64, 5000, np.uint64))
    keys = keys[np.append(True, np.diff(keys >> np.uint64(16)) > 0)]
    shard = hash_tables.shard_of(keys, shards)
    files = sum(store.put("k", s, keys[shard == s], np.arange(len(keys))[shard == s], shard[shard == s]) for s in range(shards))
    assert store.put("k", 5, keys[:0], keys[:0]) == 0
    with pytest.raises(FileNotFoundError, match="share"):
        store.seal(shards, files + 1)
    store.seal(shards, files)
    monkeypatch.setattr(hash_tables, "MOST_OPEN", 20)
    look = hash_tables.Shards(store, "k", shards, (-1, -1))
    wanted = np.concatenate([keys, rng.integers(0, 1 << 64, 5000, np.uint64)])
    known = {k: i for i, k in enumerate((keys >> np.uint64(16)).tolist())}
    want = [known.get(k, -1) for k in (wanted >> np.uint64(16)).tolist()]
    assert look(wanted, wanted)[:, 0].tolist() == want and len(look.open) <= 20
    assert look(wanted[:0], wanted[:0]).shape == (0, 2)
    assert (hash_tables.Shards(store, "other", shards, (7,))(keys, keys) == 7).all()
    os.remove(f"{store.path}/k.{shard[0]}")
    with pytest.raises(FileNotFoundError):
        hash_tables.Shards(store, "k", shards, (-1, -1))(keys, keys)


# --- toxicity ---------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(0, 9))
def test_second_person_proximity(places, others, most):
    a, b = sorted(places), sorted(others)
    assert toxicity.near_by(a, b, most) == sum(any(abs(i - j) <= most for j in b) for i in a)


def features_by_force(text, lexicon):
    """Each token looked at where it stands."""
    tokens = toxicity.WORD.findall(text)
    n = len(tokens)
    words = [toxicity.bare(t) for t in tokens]
    weight = {}
    for word in set(words):
        found = [lexicon[k] for k in toxicity.keys(word) if k in lexicon] if word else []
        if found:
            weight[word] = max(found)
    whole = {w for w in weight if w in lexicon}
    at = [i for i, w in enumerate(words) if w in weight] if weight else []
    persons = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    close = sum(1 for i in at if any(abs(i - j) <= toxicity.NEAR for j in persons))
    odd = {t for t in set(tokens) if not t.isalpha()}
    disguised = {t for t in odd if toxicity.bare(t) not in weight and any(c.isalpha() for c in t) and toxicity.INNER.search(t.strip(toxicity.EDGE)) or any(c.isdigit() for c in t) and any(c.isalpha() for c in t)}
    hidden = {t for t in disguised if any(k in lexicon for k in toxicity.keys(toxicity.plain(t)))}
    times = Counter(t for t in tokens if t in hidden) if hidden else {}
    hits, hidden_hits = len(at), sum(times.values())
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    total = sum(weight[words[i]] for i in at)
    marks = text.count("!")
    per = max(n, 1)
    return [
        hits, hits / per, len(weight), len(whole), sum(1 for i in at if words[i] in whole) / per, total, total / per,
        max(weight.values(), default=0.0), close, close / max(hits, 1), len(persons) / per,
        upper / max(letters, 1), sum(1 for t in tokens if len(t) > 1 and t.isupper()) / per,
        marks / per, text.count("?") / per, marks + text.count("?"),
        (len(text) - letters - text.count(" ")) / max(len(text), 1),
        len(disguised) / per, hidden_hits, hidden_hits / per, len(toxicity.SPELT.findall(text)),
        sum(1 for t in set(tokens) if toxicity.REPEATED.search(t)) / per, math.log1p(n), letters / per,
    ]


LEXICON = {"idiot": 2.0, "idio^": 1.5, "stup^": 1.25, "damn": 0.7, "du": 0.1, "é^": 3.0, "i": 0.2}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["you", "You,", "idiot", "IDIOT!", "1d1ot", "i.d.i.o.t", "i", "d", "o", "t", "I", "a_", "_b", "c.", "-d", "st*pid", "stupid", "stuuupid", "st00pid", "\n", "\x85", "\xa0", "du", "dein?", "é", "ÉÉÉ", "x1", "$$", "abc", "...", "ab.c", "a-b", "a*b_c", "damn", "damned"]), max_size=30),
    st.lists(st.sampled_from([" ", " ", " ", ".", "-", "", "  "]), min_size=30, max_size=30))
def test_features_against_force(tokens, gaps):
    text = "".join(t + g for t, g in zip(tokens, gaps))
    assert toxicity.features(text, toxicity.Tokens(LEXICON)) == features_by_force(text, LEXICON)


def test_features_of_documents(spark):
    known = toxicity.Tokens(LEXICON)
    known.MOST = 2000  # forgets now and then
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert toxicity.features(r.text, known) == features_by_force(r.text, LEXICON), r.doc_id


def test_features_of_very_long_texts():
    began = time.time()
    toxicity.features("you idiot " * 200_000, toxicity.Tokens({"idiot": 2.0}))
    assert time.time() - began < 30  # every hit beside every second person took hours


def test_trees_against_force():
    """Rows fall through the trees by their raw values, and the first split is the best of all by its gain."""
    rng = np.random.default_rng(0)
    x = np.round(rng.random((400, 3)), 2)
    y = ((x[:, 1] > 0.6) ^ (rng.random(400) < 0.1)).astype(float)
    model = toxicity.Boosted.fit(x, y, rounds=6, depth=2)

    def walked(row):
        score = model.start
        for feature, cut, value in model.trees:
            node = 0
            for _ in range(2):
                edges = model.edges[feature[node]]
                node = 2 * node + 1 + (cut[node] < len(edges) and row[feature[node]] > edges[cut[node]])
            score += value[node - 3]
        return score

    assert model(x) == pytest.approx([walked(row) for row in x])
    p = 1 / (1 + math.exp(-model.start))
    part = lambda rows: sum(y[rows] - p) ** 2 / (rows.sum() * p * (1 - p) + 2.0)
    gains = {(f, c): part(x[:, f] <= e) + part(x[:, f] > e) for f in range(3) for c, e in enumerate(model.edges[f]) if min((x[:, f] <= e).sum(), (x[:, f] > e).sum()) >= 10}
    feature, cut, _ = model.trees[0]
    assert gains[feature[0], cut[0]] == pytest.approx(max(gains.values()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.booleans()), min_size=1, max_size=40))
def test_isotonic_against_force(rows):
    """A block's rate is, at each of its scores, the largest over beginnings of the least mean over ends."""
    score, y = np.array([s for s, _ in rows], float), np.array([h for _, h in rows], float)
    middle, rate = toxicity.isotonic(score, y)
    known = np.unique(score)
    force = [max(min(y[(score >= a) & (score <= b)].mean() for b in known[known >= k]) for a in known[known <= k]) for k in known]
    want = {}
    for k, f in zip(known, force, strict=True):
        own = score == k
        hits, n, total = want.get(round(f, 12), (0, 0, 0))
        want[round(f, 12)] = (hits + y[own].sum(), n + own.sum(), total + score[own].sum())
    assert middle == pytest.approx([t / n for _, n, t in want.values()])
    assert rate == pytest.approx(np.maximum.accumulate([(h + 0.01) / (n + 0.02) for h, n, _ in want.values()]))


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_their_input(spark, tmp_path):
    """Each stage's rows, from what the one before kept: models' decisions row by row, copies by dictionary, classes, all ids packed."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from ledgerloom.llm import near_dedup, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda frame: sorted(tuple(r) for r in frame.collect())
    for name, module, accept, threshold in (("quality", quality, 1, quality.THRESHOLD), ("toxicity", toxicity, 0, 0.5)):
        model = module.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        want = sorted(tuple(r) for r in docs.collect() if (model([r.text or ""])[0] >= threshold) == bool(accept))
        kept = stages[name](spark, docs, SF)
        assert rows(kept) == want and 0 < len(want) <= docs.count()
        docs = spark.createDataFrame(want, docs.schema)
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    kept = stages["exact copies"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(last.values())
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    kept = stages["near copies"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {min(d for d, c in classes.items() if c == own) for own in set(classes.values())}
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path / "tables")
    empty(spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(f"{path}/documents.parquet")
    empty(spark.read.parquet(f"{SF}/labels.parquet")).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
