"""The text operators against brute force, the libraries and exact round trips, with the awkward rows of each."""

from __future__ import annotations

import glob
import hashlib
import os
import random
import re
import tempfile
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from pyspark.sql import functions as F
from tallyslot.llm import (
    common, jaccard_segments, language_spans, license_rules, phrase_index, pii_segments, piece_trie, registry,
    repair_store, repetition, token_resync, toxic_lm,
)

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE, PIECES = map(common.vocabulary_file, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n", "a", "The cat sat on the mat.", "  two  blanks \n x\ty z ", "é́ ÅÅ ß 日本語 한국어 😀👩‍👩‍👧", "a\x00b\x1cc\x85d\xa0e",
    "<|endoftext|> x <|endoftext|>", "a <|startoftext|>b", "don't they've it's 12 345", "▁▁ x ▁", "x" * 3000, "ab " * 2000 + "end",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, null and repeated ids, and columns with the names of results."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "The cat sat on the mat."), (5, "The cat sat on the mat."), (3, None)]
    return spark.createDataFrame(
        [(i, t, None, None, None, "x", 1, "y", -1.0) for i, t in rows],
        DDL + ", `n_words` string, `component_id` int, `odd name.x` string, score double",
    ).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# repetition


def test_repetition_base(docs, odd, none, texts):
    def want(text):
        w = words(text)
        c, inside = Counter(zip(w, w[1:], w[2:], strict=False)), [0] * len(w)
        for i in range(len(w) - 2):
            if c[w[i], w[i + 1], w[i + 2]] > 1:
                inside[i] = inside[i + 1] = inside[i + 2] = 1
        lines = [x for x in (text or "").split("\n") if words(x)]
        n, r = len(w), sum(inside)
        return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n

    for df in (docs, odd):
        for r in repetition.quality(df, keep=["doc_id", "text"]).collect():
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got == want(r["text"])
            assert not (r["base_failed"] and r["kept"])
    assert repetition.quality(none).count() == 0
    assert repetition.quality(odd).count() == odd.count()


def test_repetition_verdict():
    rng = random.Random(3)
    plain = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
    line = "\n".join(" ".join(f"v{rng.randrange(10**6)}" for _ in range(7)) for i in range(30))
    copied = line + "\nthe same line once more here" * 25
    got = repetition.score([plain, line, copied, plain + " " + plain[: len(plain) // 2]])
    assert list(got["kept"]) == [True, True, False, False]


def brute_shares(text):
    """The shares by plain loops over tuples of words, in units of their limits."""
    w = words(text)
    total, out = sum(map(len, w)), [0.0, 0.0]

    def inside(starts, n):
        return sum(len(w[i]) for i in {i + k for i in starts for k in range(n)})

    for n in range(2, 11):
        places = {}
        for i in range(len(w) - n + 1):
            places.setdefault(tuple(w[i : i + n]), []).append(i)
        if not places:
            break
        most = max(map(len, places.values()))
        if n in repetition.TOP_SHARE and most >= 3:
            out[0] = max(out[0], max(inside(p, n) for p in places.values() if len(p) == most) / total / repetition.TOP_SHARE[n])
        if n in repetition.DUPLICATE_SHARE:
            out[1] = max(out[1], inside([i for p in places.values() for i in p[1:]], n) / total / repetition.DUPLICATE_SHARE[n])
    said = [x for x in text.split("\n") if words(x)]
    twice = [x for i, x in enumerate(said) if x in said[:i]]
    lines = max(sum(map(len, twice)) / sum(map(len, said)) / repetition.LINE_CHARS, len(twice) / len(said) / repetition.LINE_SHARE) if said else 0.0
    return [*out, lines]


REPEATING = st.lists(st.sampled_from(["a", "b", "cc", "ddd", "日", "é#", "a\n", "b\nb", "cc\n"]), min_size=1, max_size=90).map(" ".join)


@settings(max_examples=120, deadline=None)
@given(REPEATING, st.lists(REPEATING, max_size=5), st.randoms())
def test_repetition_verdict_hangs_on_the_text_alone(text, others, rng):
    alone = repetition.score([text])
    np.testing.assert_allclose([alone[c][0] for c in ("top_share", "dup_share", "dup_line_share")], brute_shares(text))
    assert alone["kept"][0] == (not alone["base_failed"][0] and max(brute_shares(text)) <= 1)
    beside = [*others, text]
    rng.shuffle(beside)
    got = repetition.score(beside)
    at = beside.index(text)
    assert all(got[c][at] == alone[c][0] for c in got)


def test_repetition_verdict_over_partitions(spark, docs):
    want = {tuple(r) for r in repetition.quality(docs).collect()}
    for n in (1, 3, 7):
        assert {tuple(r) for r in repetition.quality(docs.repartition(n, "n_chars")).collect()} == want


# language


def test_language(spark, docs, odd, none):
    model = language_spans.train(docs)
    rows = language_spans.identify(docs, model, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    rows = {r["text"]: r for r in language_spans.identify(odd, model, keep=["text"]).collect()}
    assert {rows[t]["lang_pred"] for t in (None, "", " ", "\n")} == {"und"}
    nothing = language_spans.train(none)
    assert nothing.languages == [] and {r["lang_pred"] for r in language_spans.identify(odd, nothing).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32) * 4
    got, at = language_spans.best_labels(scores, lengths, 2.0), 0
    for n in lengths:
        s = scores[at : at + n]

        def value(path, s=s):
            return sum(s[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            best = max(value(p) for p in np.ndindex(*[3] * int(n)))
            assert value(tuple(got[at : at + n])) == pytest.approx(best, abs=1e-4)
        at += n


def test_mixed_text_has_two_spans(docs, texts):
    labeller = language_spans.SpanLabeller(language_spans.train(docs))
    of = {r["lang"]: texts[r["doc_id"]] for r in docs.collect() if r["text"] and len(r["text"]) > 600}
    mixed = " ".join(of["en"].split()[:60] + of["de"].split()[:60])
    spans = labeller.spans(mixed)
    assert [s[2] for s in spans if s[1] - s[0] > 20] == ["en", "de"]


def test_runs_without_blanks_are_read_whole(spark, docs, texts):
    """Two languages and two scripts inside one run give two spans; every n-gram of a run counts once."""
    labeller = language_spans.SpanLabeller(language_spans.train(docs))
    of = {r["lang"]: texts[r["doc_id"]] for r in docs.collect() if r["text"] and len(r["text"]) > 600}
    found = labeller(["_".join(of["en"].split()[:5] + of["de"].split()[:60]), "_".join(of["en"].split()[:60] + of["de"].split()[:60])])
    assert found["lang_pred"][0] == "de" and found["n_spans"].tolist()[1] >= 2
    scripts = spark.createDataFrame([(i, t, l) for i in range(40) for t, l in [("漢字文章" * 9, "zh"), ("ภาษาไทย" * 9, "th")]], "doc_id long, text string, lang string")
    two = language_spans.SpanLabeller(language_spans.train(scripts))
    spans = two.spans("漢字文章" * 20 + "ภาษาไทย" * 40)
    assert [s[2] for s in spans] == ["zh", "th"]
    assert two(["漢字文章" * 20 + "ภาษาไทย" * 40])["lang_pred"] == ["th"]
    long = "ab-cd_" * 30
    (raw,) = [b"\x02" + long.encode() + b"\x03"]
    cut, _ = language_spans.gram_buckets(*[list(x) for x in list(zip(*language_spans.pieces_of(long), strict=True))[1:]])
    whole, _ = language_spans.gram_buckets([raw], [len(raw)])
    assert Counter(cut.tolist()) == Counter(whole.tolist())


def test_training_reads_whole_texts(spark):
    """What comes late in a text is learned from."""
    rows = [(i, "the cat sat " * 400 + "der hund lief " * 800, "zz") for i in range(8)] + [(i, "the cat sat " * 50, "en") for i in range(8, 16)]
    model = language_spans.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_spans.SpanLabeller(model)(["der hund lief"])["lang_pred"] == ["zz"]
    text = "x 1 " + "word " * 400 + "mail joe@example.com now " + "word " * 400 + "and 1.2.3.4 " * 300
    got = pii_segments.windows(text)
    assert any("joe@example.com" in w for w in got) and max(map(len, got)) < 1300
    assert sum(len(re.findall(r"1\.2\.3\.4", w)) for w in got) >= 300
    assert pii_segments.windows("no sign") == []


def test_a_kept_text_is_sent_once_and_read_by_slices(spark):
    rows = [(i, t) for i, t in enumerate(["ab", None, "", "é" * 9, "c" * 4, "d"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def make():
        return lambda texts: {"n": [len(texts)] * len(texts), "c": [None if t is None else t.upper() for t in texts]}

    got = common.annotate(df, make, "n int, c string", keep=["text", "doc_id"], prefix="p ", limit=5)
    assert got.columns == ["text", "doc_id", "p n", "p c"]
    assert [(r[1], r[0], r[2], r[3]) for r in got.collect()] == [(i, t, n, t and t.upper()) for (i, t), n in zip(rows, (3, 3, 3, 1, 2, 2))]
    assert got._jdf.queryExecution().optimizedPlan().children().head().output().size() == 2
    ids = common.annotate(df, make, "n int, c string", text="doc_id", keep=["doc_id"])  # a text that is no string is sent beside
    assert [r["c"] for r in ids.collect()] == [str(i) for i in range(6)]


def test_latin_words_are_one_script():
    for w in ("", "12", "x1", "Straße", "\u036f", "\u00aa1", "ab\u0370", "日本", "αβγabc"):
        letters = [c for c in w if c.isalpha()]
        kinds = [language_spans.SCRIPT_AT[np.searchsorted(language_spans.STARTS, ord(c), side="right")] for c in letters]
        assert language_spans.letters_of(w) == (len(letters), sum(1 << int(k) for k in set(kinds)))
        assert "".join(language_spans.script_runs(w)) == w
        assert len(language_spans.script_runs(w)) == 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))


# tokens and pieces


def test_pieces_equal_the_library(docs, odd, none, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        for r in piece_trie.encoded(df, PIECES, keep=["text"]).collect():
            assert r["piece_ids"] == sp.encode(r["text"] or "")
    encoder = piece_trie.TrieEncoder(PIECES)
    assert all(encoder.decode(encoder.encode([t])[0]) == t for t in texts.values())
    assert piece_trie.digests(none, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdehilnorst ABC.,1290éß▁日\n", max_size=60))
def test_pieces_of_any_text(text):
    import sentencepiece

    sp, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), shared_encoder()
    assert encoder.encode([text])[0].tolist() == sp.encode(text)


ENCODER = []


def shared_encoder():
    if not ENCODER:
        ENCODER.append(piece_trie.TrieEncoder(PIECES))
    return ENCODER[0]


def test_pieces_of_a_word_are_made_once():
    import sentencepiece

    sp, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_trie.TrieEncoder(PIECES)
    texts = ["one, one. one\none!one?\n\none (one) 1one2", "  Éte\u0301 日本one語 x\u0131y\u00aa ▁one▁,▁", "\ufffd\x00a\U0001f600b"]
    encoder.encode(texts[:1])
    assert [w for w in encoder.numbers if "one" in w] == ["▁one", "one"]  # behind a blank, and behind another character
    for text in texts:
        assert encoder.encode([text])[0].tolist() == sp.encode(text)


def test_words_take_their_steps_together(monkeypatch):
    """Many words at once have the pieces that each has alone and in the library, also after all that was remembered is gone."""
    import sentencepiece

    sp, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_trie.TrieEncoder(PIECES), random.Random(11)
    letters = "abcdehilnorstß é▁日\U0001f600\x00"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 48, 49, 70]))) for _ in range(400)}, key=lambda w: rng.random())
    alone = encoder.encode_words(words)
    monkeypatch.setattr(piece_trie, "PAIRS", 500)
    for chunk in (words, words[:150], words[:7], []):
        ids, sizes = encoder.encode_all(chunk)
        assert sizes.tolist() == [len(x) for x in alone[: len(chunk)]]
        assert ids.tolist() == [i for x in alone[: len(chunk)] for i in x]
    text = " ".join("".join(rng.choice("theandionß") for _ in range(rng.randrange(1, 14))) for _ in range(800))
    assert encoder.encode([text, None, text])[0].tolist() == 2 * sp.encode(text)
    assert piece_trie.encoder_of(PIECES) is piece_trie.encoder_of(PIECES)  # a worker makes it once


def test_pieces_that_join_letters_to_marks_keep_words_whole():
    encoder = shared_encoder()
    other = object.__new__(piece_trie.Pieces)
    other.ids = {"a": 0, ".": 1, "a.": 2}
    assert other.cuts() is piece_trie.WORDS and encoder.pieces.words is not piece_trie.WORDS


def test_token_counts(docs, odd, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    for df in (docs, odd):
        for r in token_resync.token_counts(df, WORD_BPE, keep=["text"]).collect():
            t = r["text"] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids))
    assert token_resync.token_counts(none, WORD_BPE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "Cat's", "é́", "日本", "12", "...", "x" * 40, "<|endoftext|>", "\n", "ÅB"]), max_size=80), st.sampled_from([7, 16, 50]))
def test_spliced_chunks(parts, chunk):
    counter = token_resync.TokenCounter(WORD_BPE, chunk=chunk, overlap=3)
    for text in (" ".join(parts), "".join(parts)):
        assert counter([text])["n_tokens"][0] == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_id_store(spark, docs, odd, none, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTE_BPE)
    for n, df in enumerate((docs, odd)):
        path = str(tmp_path / str(n))
        repair_store.write(df, BYTE_BPE, path, block=3000)
        got = sorted(tuple(r) for r in repair_store.read_back(repair_store.read(spark, path)).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for r in rows:
            ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), r["doc_id"]))
            start += len(ids)
        assert got == want
    repair_store.write(none, BYTE_BPE, str(tmp_path / "none"))
    assert repair_store.read_back(repair_store.read(spark, str(tmp_path / "none"))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300))
def test_grammar_round_trip(ids):
    ids = np.array(ids, np.int32)
    rules, spans, symbols = repair_store.compress(ids, 5, least=2)
    block = repair_store.Block(5, rules.tobytes(), spans.tobytes(), symbols.tobytes())
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) // 2, len(ids))):
        assert block.decoded(a, b).tolist() == ids[a:b].tolist()


def test_words_are_encoded_apart_from_their_marks():
    encoder = repair_store.ChunkEncoder(BYTE_BPE)
    texts = ["Straße, straße. straße; word... word!? can't' can't, a\u00d7, \u01c5. 12. x<|endoftext|>, <|endoftext|>", "word,\nword ,word -word- .", ""]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(u in ("word", "straße") for u in encoder.units) == 2  # each word once, whatever marks close it


def test_bins_of_pairs_do_not_change_the_grammar(monkeypatch):
    ids = np.random.default_rng(1).zipf(1.3, 20_000).clip(0, 99).astype(np.int32)
    want = repair_store.compress(ids, 100, least=2)
    monkeypatch.setattr(repair_store, "BINS", 1)  # all pairs are sorted
    assert all((a == b).all() for a, b in zip(want, repair_store.compress(ids, 100, least=2), strict=True))


# benchmark passages


def brute_hits(text, items, window=13):
    w = re.findall(phrase_index.WORD, lower(text))
    hit, held = set(), set()
    for key, item in items:
        v = re.findall(phrase_index.WORD, lower(item))
        n = min(window, len(v))
        for s in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit.update(range(i, i + n))
                    held.add(key)
    ids = sorted(str(k) for k in held if k is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark, none):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "the"]
    long = [rng.choice(vocabulary) for _ in range(40)]
    items = [(1, " ".join(long)), (2, "the w1"), (3, ""), (4, None), (None, "w3 the w3"), (12, "w5 w5 w5"), (2, "the w1"), (7, "Zz")]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(40)]
    rows += [(50, "x, " + " ".join(long[3:20]) + " y"), (51, " ".join(long[3:15])), (52, "THE-W1 " * 5), (53, None), (54, ""), (None, "w5 w5 w5 w5"), (52, "THE-W1 " * 5), (55, "zz")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_hit int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), *r[2:]) for r in phrase_index.contamination(docs, bench).collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    kept = phrase_index.drop_contaminated(docs, bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i, t in rows if not brute_hits(t, items)[-1])
    assert phrase_index.contamination(none, bench).count() == 0
    assert phrase_index.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta the the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "delta x gamma y alpha the beta"), (2, "alpha beta " + "the " * 40 + "gamma delta"), (3, "alpha")], "doc_id long, text string")
    index = phrase_index.build(docs, bench)
    assert [(r["doc_id"], r["stop"]) for r in phrase_index.proximity_matches(index).collect()] == [(1, 7)]


# near duplicates


def brute_components(rows, shingle=4, per_cent=85):
    sets = []
    for _, t in rows:
        w = lower(t).split(" ") and words(lower(t))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= per_cent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            groups[find(i)] = min(groups.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), len(sets[i]), str(groups.get(find(i), rows[i][0]))) for i in range(len(rows)))


def near_copies(seed, passage=30):
    """Groups of near copies, short texts, a passage in very many texts, and texts that are hardly more than it."""
    rng, rows = random.Random(seed), []
    shared = [f"p{i}" for i in range(passage)]
    for g in range(6):
        base = [f"g{g}w{rng.randrange(50)}" for _ in range(rng.choice([5, 8, 9, 12, 16, 25, 60, 120]))]
        for _ in range(rng.choice([2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"], [f"n{rng.randrange(99)}"]])
            rows.append(" ".join(w))
    rows += [" ".join(shared + [f"r{rng.randrange(4)}" for _ in range(rng.randrange(0, 6))]) for _ in range(30)]
    rows += [" ".join([f"z{rng.randrange(999)}" for _ in range(rng.randrange(0, 9))]) for _ in range(10)]
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, ""), (902, " \t"), (None, rows[0]), (3, rows[3]), (903, rows[0].upper())]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"least": 2}), (3, {"least": 3, "small": 2, "pivots": 1}), (4, {"least": 2, "shingle": 5, "per_cent": 80})])
def test_components(spark, seed, options):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_segments.jaccard_components(docs, **options).collect())
    assert got == brute_components(rows, options.get("shingle", 4), options.get("per_cent", 85))


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    """Representatives past the limit are looked up by their keys alone, and late pairs are merged, however small their files."""
    monkeypatch.setattr(jaccard_segments, "BROADCAST_ROWS", 0)
    plans, materialise = [], jaccard_segments.materialise
    monkeypatch.setattr(jaccard_segments, "materialise", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or materialise(df, label))
    rows = near_copies(3)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    options = {"least": 3, "small": 2, "pivots": 1}
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_segments.jaccard_components(docs, **options).collect())
    assert got == brute_components(rows, 4, 85)
    texts, pairs = ([p for label, p in plans if label == f"jaccard-{what}"] for what in ("texts", "pairs"))
    assert len(texts) == len(pairs) == 2
    assert "ArrowEvalPython" in texts[0]
    assert "SortMergeJoin" in pairs[1] and "Broadcast" not in pairs[1]


def test_odd_bits_part_no_linked_sets(spark):
    rng = np.random.default_rng(7)
    rows, near = [], []
    for n in (1, 4, 9, 30, 200, 900):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(60):
            gone, new = rng.integers(0, n // 4 + 1, 2)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            near.append(100 * shared >= 85 * (len(a) + len(b) - shared))
            rows.append((len(rows), len(a), len(b), *jaccard_segments.oddness(a).tolist(), *jaccard_segments.oddness(b).tolist()))
        rows.append((len(rows), n, n, *jaccard_segments.oddness(a).tolist(), *jaccard_segments.oddness(a + np.uint64(12345678901)).tolist()))
        near.append(False)
    names = ["i", "na", "nb", *(f"{s}_{o}" for s in "ab" for o in jaccard_segments.ODD)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    sides = [F.struct(*[F.col(f"{s}_{o}").alias(o) for o in jaccard_segments.ODD]).alias(s) for s in "ab"]
    kept = {r["i"] for r in df.select("i", "na", "nb", *sides).where(jaccard_segments.differ_little("na", "nb", "a", "b", 85)).collect()}
    assert {i for i, linked in enumerate(near) if linked} <= kept
    assert len(rows) - 1 not in kept  # 900 shingles that have none in common are told apart


def test_one_of_each_stays(spark, none):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (3, "x"), (4, None), (5, ""), (6, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"]) for r in jaccard_segments.keep_one(docs).filter("text <> ''").collect())
    assert kept == [(1, "a b c d e f"), (3, "x"), (6, "other words here now")]
    assert jaccard_segments.keep_one(docs).count() == 5
    assert jaccard_segments.jaccard_components(none).count() == 0


# personal data


def test_base_spans():
    for t in [
        "mail a.b@c.d-e.f, x@y z@@w.com @a.b q@r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 400,
        "+1 (255) 555-8013 +12 +1-2-3-4-5-6-7-8-9-0", "a@b.c@d.e", "",
    ]:
        found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for k, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m.group())
                if low <= len(d) <= high and (k == 3 or pii_segments.luhn(d)):
                    found.append((m.start(), m.end(), k))
        assert pii_segments.base_spans(t) == sorted(found, key=lambda s: (s[0], s[2]))


def test_field(spark, docs, odd, none):
    field = pii_segments.train(docs)
    base, every = pii_segments.all_spans("call (255) 555-8013 or joe.x@mail.example.com about version 2.0 of 2024", field)
    assert len(base) == 1 and set(base) <= set(every)
    assert "version" not in pii_segments.redacted("a@b.cc 1.2.3.4", pii_segments.base_spans("a@b.cc 1.2.3.4"))
    assert pii_segments.redacted("to a@b.cc, 1.2.3.4", pii_segments.base_spans("to a@b.cc, 1.2.3.4")) == "to [EMAIL], [IP]"
    assert pii_segments.find(odd, field).count() == odd.count()
    assert pii_segments.find(none, pii_segments.train(none)).count() == 0


def test_field_finds_looser_writings(spark):
    """Each writing that the training makes is found."""
    field = pii_segments.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    parts = [("john@example.com", 0), ("mary.poe@mail.example.org", 0), ("4111 1111 1111 1111", 2), ("+1 (255) 555-8013", 3)]
    for part, kind in parts:
        for new in {pii_segments.loosened(part, kind, random.Random(n)) for n in range(40)}:
            text = f"please write to {new} about the meeting"
            a = text.index(new)
            assert (a, a + len(new), kind) in pii_segments.all_spans(text, field)[1], new
    assert pii_segments.redacted("at john @ example.com now", pii_segments.all_spans("at john @ example.com now", field)[1]) == "at [EMAIL] now"


def test_field_sums_over_all_divisions():
    """The best division by the dynamic programme is the best of all divisions."""
    field = pii_segments.Field({"card|digits=4": 4.0, "phone|digits=8": 7.0, "ip|digits=4": 3.5})
    assert field.divided("1234 5678", 0, 9) == [(0, 4, 2), (5, 9, 2)]
    field.weights["phone|digits=8"] = 9.0
    assert field.divided("1234 5678", 0, 9) == [(0, 9, 3)]


# licences and toxicity


def test_licenses(spark, odd, none):
    text = "Some words.\n\nLicensed under the Apache License, Version 2.0.\n\nThis program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThe end. Released under the MIT License. All rights reserved."
    got = license_rules.score([text, None, "", "A license to think.", "Licensed under CC BY-NC 4.0."])
    assert list(got["licenses"]) == ["Apache-2.0,GPL-3.0-or-later,MIT", "", "", "", "CC-BY-NC-4.0"]
    assert list(got["unmatched"])[0] == "reserved"
    assert license_rules.scan(odd).count() == odd.count() and license_rules.scan(none).count() == 0


def test_latin_words_go_to_the_merges(monkeypatch):
    """Words of Latin letters skip the pre-tokenizer, and a worker's next task finds what its last one has learned."""
    encoder = repair_store.encoder_of(BYTE_BPE)
    text = "x Ärger, naïve ſtraße Ångström Łódź ǅ ȿ don't and\nmore **marks** ª " + " ".join(f"w{chr(c)}ord" for c in range(0xC0, 0x250))
    whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode([text, None, ""])[0].tolist() == whole
    assert encoder.kind("Ärger") == 2 and encoder.kind("don't") == encoder.kind("\u01c5\u00d7") == 0
    monkeypatch.setattr(encoder, "learn", None)
    assert repair_store.encoder_of(BYTE_BPE).encode([text])[0].tolist() == whole


def test_toxicity(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxic_lm.train(large, labels)
    rows = toxic_lm.toxicity(large, model).join(labels, "doc_id").collect()
    toxic, plain = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    better = np.mean([a > b for a in toxic for b in plain])
    assert better > 0.9 and all(0 <= s <= 1 for s in toxic + plain)
    assert toxic_lm.toxicity(odd, model).count() == odd.count()
    assert toxic_lm.train(none, labels) is None
    assert {r["score"] for r in toxic_lm.toxicity(odd, None).collect()} == {0.0}


def test_toxic_counts_have_no_bound(spark, odd, monkeypatch):
    """Counts come from all labelled texts, bigrams seen once too; joined by shuffle or sent, they say the same."""
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"we met w{i} v{i} and " + ("vile scum" if i % 4 == 0 else "kind folk")) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    counted = [i for i in ids if zlib.crc32(str(i).encode()) % 5 < 4]
    sent = toxic_lm.train(docs, labels, rows=5)
    keys = set(sent.words.pairs.tolist())
    assert all((toxic_lm.word_number(f"w{i}") << toxic_lm.BITS) | toxic_lm.word_number(f"v{i}") in keys for i in counted)
    monkeypatch.setattr(toxic_lm, "BLOCK_CHARS", 2_000)
    dealt = toxic_lm.train(docs, labels, rows=5, most_bytes=0)
    assert dealt.stored is not None and np.allclose(dealt.weights, sent.weights, atol=1e-5)
    for table in (docs, odd):
        a, b = (sorted((str(r["doc_id"]), r["predicted"], round(r["score"], 4)) for r in toxic_lm.toxicity(table, m).collect()) for m in (sent, dealt))
        assert a == b and len(a) == table.count()


def shuffle_files() -> set[str]:
    """Data of shuffles that Spark holds on this machine."""
    return set(glob.glob(os.path.join(tempfile.gettempdir(), "blockmgr-*", "*", "shuffle_*.data")))


def test_toxic_shuffles_go_with_their_turn(spark, tmp_path, monkeypatch):
    """Bigrams past the limit: texts are judged in turns, and no turn leaves shuffle files behind."""
    monkeypatch.setattr(toxic_lm, "BLOCK_CHARS", 2_000)
    monkeypatch.setattr(toxic_lm, "ROUND_BLOCKS", 2)
    monkeypatch.setattr(toxic_lm, "PART_PAIRS", 100)
    kept, materialise = [], toxic_lm.materialise
    monkeypatch.setattr(toxic_lm, "materialise", lambda df, label: kept.append(label) or materialise(df, label))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"we met w{i} and " + ("vile scum" if i % 4 == 0 else "kind folk")) for i in ids], "doc_id long, text string")
    before = shuffle_files()
    model = toxic_lm.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int"), rows=20, most_bytes=0)
    got = toxic_lm.toxicity(docs, model)
    for _ in range(50):  # Spark deletes them in the background
        if shuffle_files() <= before:
            break
        time.sleep(0.2)
    assert shuffle_files() <= before
    assert kept.count("toxic-told") > toxic_lm.ROUNDS and model.parts > 8
    assert sorted(r["doc_id"] for r in got.collect()) == ids


def test_whole_pieces_are_judged(spark):
    """What stands late in a run without blanks counts, and does not depend on how the run is cut for memory."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    kind = ["we", "met", "some", "kindly", "folk", "near", "green", "hills"]
    rows = [(i, " ".join(kind[(i + j) % 8] for j in range(20)) + (" vilescum dirtbags" if i % 4 == 0 else "")) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxic_lm.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int"))
    plain = "_".join(kind * 6)
    bad = plain + "_vilescum_dirtbags_" + plain
    x = model.features(toxic_lm.Words(model.units), [plain + "_" + plain, bad, plain])
    assert x[1, 6] > x[0, 6] + 1 and x[1, 7] > x[0, 7] + 1  # the most toxic stretch and part
    p = model.score(x)
    assert p[1] > 0.5 and p[1] > p[0]
    words = ["", "a", "kind", bad, "\U0001f600日本語" * 50, bad[:67]]
    whole, cut = ([np.concatenate(c) for c in zip(*toxic_lm.unit_runs(words, n), strict=True)] for n in (1 << 20, 7))
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert np.bincount(whole[0]).tolist() == [toxic_lm.unit_count(w) for w in words]


def test_held_out_labels_change_nothing(spark):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}
    docs = spark.createDataFrame([(i, f"we met w{i % 9} " + ("vile scum" if i % 4 == 0 else "kind folk")) for i in held], "doc_id long, text string")
    a, b = (
        toxic_lm.train(docs, spark.createDataFrame([(i, y if h else int(i % 4 == 0)) for i, h in held.items()], "doc_id long, toxic int"))
        for y in (0, 1)
    )
    assert np.array_equal(a.weights, b.weights)


def test_models_are_kept_and_sent_once(spark, tmp_path, monkeypatch):
    """One table of bigrams, and one broadcast for the curve and for all scores, smaller than its arrays."""
    kept = []
    monkeypatch.setattr(toxic_lm, "materialise", lambda df, label: kept.append(label) or df.localCheckpoint())
    docs = spark.createDataFrame([(i, f"we met w{i} and " + ("vile scum" if i % 4 == 0 else "kind folk")) for i in range(300)], "doc_id long, text string")
    model = toxic_lm.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert kept == ["toxic-marks", "toxic-bigrams"]
    sent = model.sent
    toxic_lm.toxicity(docs, model).count()
    assert sent is not None and model.sent is sent
    for k in (model.words, model.units):
        again = toxic_lm.KneserNey.unpacked(k.packed())
        for name in ("pairs", "counts", "rest", "unigram", "seen", "discount"):
            a, b = getattr(k, name), getattr(again, name)
            assert a.dtype == b.dtype and a.shape == b.shape and np.array_equal(a, b)
        assert sum(len(x[0]) for x in k.packed()[:5]) < k.rest.nbytes // 4
    assert model.words.counts.dtype == np.uint8 and len(model.words.pairs)
    for x in (np.zeros((0, 2), np.uint8), np.zeros(0, np.int64), np.arange(7) << 33, np.array([[1.5, -2.0]])):
        assert np.array_equal(toxic_lm.unpacked(toxic_lm.packed(x)), x)


# pipeline and registry


def test_pipeline_stages(spark, none, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        extra = ["piece_ids"] if name == "pieces" else []
        assert out.columns == docs.columns + extra
        assert out.count() <= docs.count()
    one = corpus_pipeline.one_of_each(spark, docs, SF).count()
    want = len({c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)})
    assert one == want
    for stage in (corpus_pipeline.known_language, corpus_pipeline.no_personal_data, corpus_pipeline.piece_ids, corpus_pipeline.one_of_each):
        assert stage(spark, none, SF).count() == 0
        stage(spark, odd, SF).count()


def test_no_language_learned_drops_no_letters(spark):
    rows = [(1, "plain words", None, "x", 11), (2, "", None, "x", 0), (3, None, None, "x", None), (4, "12 !", None, "x", 4), (5, "漢字", None, "x", 2)]
    kept = corpus_pipeline.known_language(spark, spark.createDataFrame(rows, DDL), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_oracles(spark):
    from tests.compare import connect, differences

    con = connect(SF)
    for name, sql in registry.oracle_sql().items():
        assert differences(registry.queries()[name](spark, SF), con, sql) == [], name
