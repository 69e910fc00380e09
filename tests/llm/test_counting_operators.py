"""Filter audit, collocations and exact copies against brute force, with the awkward rows of each."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyslot.llm import byte_words, collocations, exact_copies, filter_audit

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sample(seed, n=160):
    """Rows with nulls in every column, empty and long texts, copies, repeated rows and ids, odd characters."""
    rng = random.Random(seed)
    pool = ["the", "The", "cat", "of", "new", "york", "city", "é́", "日本", "a\x00b", "x" * 300, "y" * 300 + "z", "#", "A", "ab.cd", " ", "o\x0bp"]
    texts = [None, "", " ", "\n.\t", "Z" * 40, "new york city " * 60, "a " * 60, "x" * 300 + " " + "y" * 300 + "z", "w&x " * 70]
    for _ in range(n // 3):
        texts.append(rng.choice([" ", "\t", "  "]).join(rng.choice(pool) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.randrange(1, 120))))
    rows = []
    for i in range(n):
        text = rng.choice(texts[:9]) if rng.random() < 0.3 else rng.choice(texts)
        rows.append((rng.choice([i, i, i, None, 5]), text, rng.choice(["en", "fr", None, "und"]), rng.choice(["s1", "s1", "", None]), 1))
    return rows + rows[:7]


def frame(spark, rows, parts=5):
    """The rows with more columns, some named like results and intermediate columns."""
    extra = ", `n` string, `digest` int, `word` string, `part` double, `odd name.x` string, `top` long, `c0` int, kept string"
    return spark.createDataFrame([(*r, "n", 1, "w", 0.5, "o", 2, 3, "k") for r in rows], DDL + extra).repartition(parts)


# spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aAé日 \n\t#.b", max_size=40), st.just("q" * 270 + " " + "q" * 270 + "r")), max_size=8), st.sampled_from([1, 7, 50, 1 << 20]))
def test_counts_equal_regular_expressions(texts, limit):
    got = [tuple(int(v[i]) for v in c.values()) for _, hi, t in byte_words.blocks(pa.array(texts, pa.string()), limit) for c in [filter_audit.count(t)] for i in range(len(t.ends))]
    want = []
    for t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        want.append((len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))))
    assert got == want


def test_table_survives_equal_hashes():
    """Words with one hash stay apart, because hits are compared byte by byte."""
    words = ["alpha", "beta", "alpha", "gamma", "beta", "a" * 300, "a" * 299 + "b", "a" * 300]
    ((_, _, texts),) = byte_words.blocks(pa.array([" ".join(words)]))
    starts, lengths = texts.spans((filter_audit.MACHINE.run(texts.data, texts.first) & 1).astype(bool))
    none = np.zeros(len(starts), np.uint64)
    stands = byte_words.insert_spans(texts, starts, lengths, none, np.zeros(len(starts), np.int64))
    assert [words[i] for i in stands] == words and len(set(stands.tolist())) == len(set(words))


# filter audit


def brute_audit(rows, labels):
    least = {}
    for i, t, *_ in rows:
        t = t or ""
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, _, source, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[source or ""].append(({x for x in fails if fails[x]}, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        totals = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d in docs if x in d[0] and not d[0] & before]
                totals[x] += len(removed)
                out[part, order, step] = [
                    sum(not d[0] & (before | {x}) for d in docs), len(removed), sum(x in d[0] and bool(d[0] & before) for d in docs),
                    sum(d[0] == {x} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(totals[order[step - 1]])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    rows = sample(seed)
    labels = [(1, 1, 0), (1, None, 1), (None, 1, 1), (5, 0, 1), (5, 1, None), (12, 1, 1), (30, None, None), (999, 1, 1)]
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_audit_of_empty_tables(spark):
    none, marks = spark.createDataFrame([], DDL), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, marks).count() == 0
    assert filter_audit.audit(frame(spark, sample(3, 12)), marks).count() % 600 == 0


# collocations


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            longer = max((b for h, b in f.items() if len(h) == 3 and b >= least and len(g) == 2 and g in (h[:2], h[1:])), default=0)
            if 100 * longer >= 50 * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))  # noqa: E741
            found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed,limits", [
    (1, collocations.Limits()), (2, collocations.Limits(hot=20, block=700)), (3, collocations.Limits(hot=5, block=64, entries=3)),
    (4, collocations.Limits(hot=3, block=1, filter_bits=15, entries=1)),
])
def test_collocations(spark, seed, limits):
    """Also with stripes cut for hot prefixes, short stripe rows, and long texts cut at separators."""
    rows = sample(seed)
    got = collocations.top_phrases(frame(spark, rows), top=60, least=4, limits=limits).collect()
    want = brute_phrases(rows, 4, 60)
    assert sorted(tuple(r) for r in got) == want and any(len(r[2].split(" ")) == 3 for r in want)


def test_collocations_of_empty_texts(spark):
    assert collocations.top_phrases(spark.createDataFrame([], DDL)).count() == 0
    assert collocations.top_phrases(frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " . \n", "en", "s", 4)])).count() == 0


def test_words_with_one_hash_take_another_seed(spark):
    """Where two words share a hash the counts are made again with another seed, until none do."""
    rows, limits = sample(5), collocations.Limits(hash_bits=9)
    docs = frame(spark, rows).select("lang", "text").fillna("und", ["lang"])
    clashes = collocations.word_counts(docs, limits).groupBy("lang", "hash").count().where("count > 1").count()
    assert clashes > 0
    got = collocations.top_phrases(frame(spark, rows), top=60, least=4, limits=limits).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, 4, 60)


def test_filter_says_yes_to_what_is_in_it(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    made = collocations.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"), 20)
    assert made.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 5000).view(np.uint64)
    assert made.has(others).mean() < 0.05


def test_scores_past_64_bits(spark):
    a, l, r = 9 * 10**13, 9 * 10**13 + 1, 99_999_999_999_999  # noqa: E741
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations._score("a", *[collocations.F.col(c) for c in "lr"]).alias("s"))
    assert got.first()[0] == 10**6 * a * a // (l * r)


# exact copies


def test_summary_keeps_every_frequent_digest():
    rng = random.Random(7)
    stream = [b"hot"] * 300 + [b"warm"] * 150 + [str(rng.randrange(10**6)).encode() for _ in range(900)]
    rng.shuffle(stream)
    summary = exact_copies.Summary(9)
    for i in range(0, len(stream), 17):
        summary.add(pa.array(stream[i : i + 17], pa.binary()))
        assert summary.held.num_rows <= 9
    held = dict(zip(summary.held["digest"].to_pylist(), summary.held["n"].to_pylist(), strict=True))
    for word in (b"hot", b"warm"):
        true = stream.count(word)
        assert true - len(stream) / 10 <= held[word] <= true


@pytest.mark.parametrize("heavy", [2, 6, 1024])
def test_copies(spark, heavy):
    rows = sample(9)
    # repeated rows cannot be told apart, so one of each is counted as the one that stays
    got = Counter(tuple(r) for r in exact_copies.copies(frame(spark, rows), heavy=heavy).collect())
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    want = Counter()
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        stayed = False
        for i in ids:
            stays = i == top and not stayed
            stayed |= stays
            want[i, top, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    docs = frame(spark, rows)
    kept = exact_copies.drop_copies(docs, heavy=heavy)
    assert kept.columns == docs.columns and kept.count() == len(by) == kept.select("text").fillna("").distinct().count()


def test_copies_of_nothing(spark):
    none = spark.createDataFrame([], DDL)
    assert exact_copies.copies(none).count() == 0 and exact_copies.drop_copies(none).count() == 0


def test_frequent_texts_are_not_shuffled(spark):
    """The hot digests are answered by a broadcast join; their number is bounded by the parameter."""
    rows = [(i, "hot" if i % 3 else f"t{i}", "en", "s", 1) for i in range(300)]
    digests = spark.createDataFrame(rows, DDL).select(
        exact_copies.F.col("doc_id").alias("id"), exact_copies.digest().alias("digest"), exact_copies.F.col("n_chars").alias("row")
    )
    found = exact_copies.frequent(digests, 8).collect()
    assert [(r["size"], r["top"]["id"]) for r in found] == [(200, 299)]
