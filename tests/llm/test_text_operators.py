"""Quality, language, token counts, toxicity against brute force, and their odd rows."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import ENGLISH, GERMAN, TEXTS, bag, empty, frame
from palaver.llm import language, quality, token_counts, toxicity
from palaver.llm.queries import QUERIES, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG_WORDS = " ".join(f"long{i % 301}" for i in range(5000))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit), n < 50 or 100 * len(hit) > 50 * n


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_quality_counts_of_odd_rows(spark):
    got = bag(quality.quality_rules(frame(spark), no_labels(spark)).select("doc_id", *FIELDS))
    assert got == sorted(((i, *base(t)) for i, t, _ in TEXTS), key=repr)
    assert quality.quality_rules(empty(spark), no_labels(spark)).count() == 0


def test_quality_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(tuple(r[f] for f in FIELDS) == base(docs[r.doc_id]) for r in rows)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_ratio_by_hand(spark):
    rows = [(1, "good good news " * 20, None), (2, "junk junk junk " * 20, None)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.llr for r in quality.quality_rules(frame(spark, rows), labels).collect()}
    assert got[1] > 0 > got[2]


def buckets_by_hand(text):
    """Buckets of the words and of the pairs of neighbouring words of a text, one word at a time."""
    from palaver.llm.common import Hasher, mix

    hashes = []
    for word in WORD.findall(text or ""):
        hasher = Hasher()
        data = np.frombuffer(word.encode(), np.uint8)
        hasher.load(data)
        hashes.append(hasher.ranges(np.array([0]), np.array([len(data)])))
    shift = np.uint64(64 - quality.BUCKET_BITS)
    single = [int((mix(h + np.uint64(1)) >> shift)[0]) for h in hashes]
    pairs = [int((mix(a * np.uint64(3) + b * np.uint64(5)) >> shift)[0]) for a, b in itertools.pairwise(hashes)]
    return single + pairs


def test_quality_ratios_by_brute_force(spark):
    """Mean log-ratio and verdict of every row from counts kept in dictionaries."""
    good, bad = "a fine story told well with care and wit", "buy now click here cheap cheap deal offer"
    rows = [(i, " ".join(f"{good if i % 2 else bad} {i % 7}" for _ in range(3 + i % 5)), None) for i in range(40)]
    rows += [(50 + i, " ".join(f"{('fine', 'care', 'deal')[j % 3]} part{j}" for j in range(30 + i)), None) for i in range(6)]
    rows += [(40, None, None), (41, "", None), (41, good, None), (None, bad * 9, None), (42, LONG_WORDS, None)]
    trusted = {1, 3, 5, 7, 41, 52, 99}
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    for i, text, _ in rows:
        some = buckets_by_hand(text)
        raw.update(some)
        if i in trusted:
            target.update(some)
    scale = sum(target.values()) / sum(raw.values())

    def ratio(bucket):
        return math.log((target[bucket] + quality.SMOOTHING) / (raw[bucket] * scale + quality.SMOOTHING))

    expected = []
    for i, text, _ in rows:
        some = buckets_by_hand(text)
        llr = sum(map(ratio, some)) / len(some) if some else 0.0
        expected.append((i, round(llr, 9), not base(text)[-1] and llr >= quality.THRESHOLD))
    got = quality.quality_rules(frame(spark, rows), labels).select("doc_id", F.round("llr", 9), "kept")
    assert bag(got) == sorted(expected, key=repr)
    assert {kept for _, _, kept in expected} == {True, False}


def profile_by_hand(text, vectors):
    """The sum of bound, permuted letter vectors over all 3-grams, one at a time."""
    table = language._letters()
    symbols = [0]
    for c in text:
        letter = int(table[ord(c)])
        if letter or symbols[-1]:
            symbols.append(letter)
    symbols += [0] if symbols[-1] else []
    total = np.zeros(vectors.dimensions)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if b:
            x, y, z = (vectors.of(np.array([s]))[0] for s in (a, b, c))
            total += np.roll(x, 2) * np.roll(y, 1) * z
    return total


def test_language_prototypes_and_cosines_by_brute_force(spark):
    vectors = language.LetterVectors()
    small = [(i, t, lang) for i, t, lang in TEXTS if t is None or len(t) < 1000]
    profiles = {}
    for _, text, lang in small:
        if text is not None and lang is not None:
            profiles[lang] = profiles.get(lang, 0) + profile_by_hand(text, vectors)
    names = sorted(lang for lang, p in profiles.items() if np.linalg.norm(p))
    langs, table_ = language.prototypes(frame(spark, small))
    assert langs == names
    unit = np.stack([profiles[x] / np.linalg.norm(profiles[x]) for x in names])
    assert np.allclose(table_, unit, atol=1e-6)
    expected = []
    for i, text, _ in small:
        profile = profile_by_hand(text or "", vectors)
        cosines = unit @ profile / max(np.linalg.norm(profile), 1e-9)
        known = np.linalg.norm(profile) > 0
        expected.append((i, names[int(cosines.argmax())] if known else "und", round(float(np.clip(cosines.max(), 0, 1)), 4) if known else 0.0))
    got = language.identify(frame(spark, small), langs, table_)
    assert bag(got.select("doc_id", "lang_pred", F.round("score", 4))) == sorted(expected, key=repr)


def test_language_of_odd_rows(spark):
    docs = frame(spark)
    langs, table_ = language.prototypes(docs)
    assert langs == ["de", "en", "ja"]
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, langs, table_).collect()}
    assert {(1, "en"), (2, "de"), (7, "en"), (8, "en"), (9, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "und")} <= got
    rows = language.identify(docs, langs, table_).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.keep_known(docs, langs, table_)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())
    assert language.prototypes(empty(spark))[0] == []
    assert {r.lang_pred for r in language.identify(docs, *language.prototypes(empty(spark))).collect()} == {"und"}
    assert language.identify(empty(spark), langs, table_).count() == 0


def test_short_texts_of_a_learned_language_stay(spark, sf_dir):
    langs, table_ = language.prototypes(table(spark, sf_dir, "documents"))
    letters = random.Random(5)
    noise = ["".join(letters.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000)) for _ in range(20)]
    short = ["Avec.", "A.", "A.\nAll rights reserved.", "A. " * 2000]
    docs = frame(spark, [(i, t, None) for i, t in enumerate([*short, "12 !", *noise])])
    score = {r.doc_id: r.score for r in language.identify(docs, langs, table_).collect()}
    low = {i for i in score if score[i] < language.MIN_SCORE}
    assert low & set(range(len(short)))
    assert {r.doc_id for r in language.keep_known(docs, langs, table_).collect()} == set(score) - (low - set(range(len(short))))
    assert len(low) > 15


def test_language_profile_by_hand(spark):
    """The matrix form gives the bundle that adding up bound, permuted vectors gives."""
    import numpy as np

    vectors = language.LetterVectors()
    data = np.frombuffer("Ab c".encode(), np.uint8)
    grams = language.Grams(data, np.array([0, len(data)]))
    got = grams.bundle(grams.text, 1, vectors)[0]
    edge, a, b, c = (vectors.of(np.array([x]))[0] for x in (0, ord("a"), ord("b"), ord("c")))
    expected = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in ((edge, a, b), (a, b, edge), (edge, c, edge)))
    assert (got == expected).all()


def test_language_query(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.public_path(token_counts.MODEL))


def test_token_counts_of_odd_rows(spark, pieces):
    got = bag(token_counts.count_tokens(frame(spark), limit=20))
    expected = [(i, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 20) for i, t, _ in TEXTS]
    assert got == sorted(expected, key=repr)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_safe_cuts_change_nothing(pieces):
    text = (ENGLISH + ", " + GERMAN + " 12 x  y") * 50
    for size in (1, 7, 100):
        parts = list(token_counts.pieces_of(text, size))
        assert sum(len(pieces.encode(p)) for p in parts) == len(pieces.encode(text))
    assert list(token_counts.pieces_of("a" * 50, 10)) == ["a" * 50]


SCRIPTS = {
    "cyrillic": "Съешь же ещё этих мягких французских булок, да выпей чаю № 5 ",
    "arabic": "نص حكيم له سر قاطع وذو شأن عظيم مكتوب على ثوب أخضر ",
    "cjk": "日本語 の 文章 に は 普通 空白 が ない ｶﾞ ㍿ ",
    "greek": "Ξεσκεπάζω τὴν ψυχοφθόρα βδελυγμία ﬁ ",
    "hindi": "ऋषियों को सताने वाले दुष्ट राक्षसों के राजा रावण ",
    "korean": "다람쥐 헌 쳇바퀴에 타고파 ㈜ ",
    "marks": "e\u0301 a\u0308 \u0301x \u200b y \xa0 z \u3000 w \uac00 \u11a8 ",
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_safe_cuts_in_every_script(pieces, script):
    text = SCRIPTS[script] * 40
    whole = len(pieces.encode(text))
    for size in (1, 5, 64, 300):
        parts = list(token_counts.pieces_of(text, size))
        assert sum(len(pieces.encode(p)) for p in parts) == whole, size
        assert len(parts) > 1 or script == "marks"


@pytest.mark.parametrize("script", ["cyrillic", "cjk"])
def test_very_long_texts_are_cut(pieces, script):
    """Ten megabytes: no piece much longer than asked for, batches of about their bytes, the library's count."""
    text = SCRIPTS[script] * (10_000_000 // len(SCRIPTS[script].encode()))
    parts = list(token_counts.pieces_of(text))
    assert len(parts) > 50 and max(map(len, parts)) < token_counts.PIECE_CHARS + 100
    batches = list(token_counts._batches(((0, p) for p in parts), token_counts.BATCH_BYTES))
    sizes = [sum(len(p.encode()) for p in some) for _, some in batches]
    assert max(sizes) < token_counts.BATCH_BYTES + 4 * (token_counts.PIECE_CHARS + 100) and min(sizes[:-1]) >= token_counts.BATCH_BYTES
    assert sum(len(pieces.encode(p)) for p in parts) == len(pieces.encode(text))


def test_token_query(spark, sf_dir, pieces):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op3_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(pieces.encode(t or "")) for i, t in docs.items()}


def labelled(spark, n=60):
    rows = [(i, f"{ENGLISH} {'what a stupid clown' if i % 3 == 0 else 'what a nice day'} number{i}", None) for i in range(n)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return frame(spark, rows), labels


def test_toxicity_restores_hidden_words(spark):
    docs, labels = labelled(spark)
    letters = toxicity.fit_letters(docs)
    hidden = ["a stup1d one", "s t u p i d", "what a cl0wn!", "cloooown", "st.u.p.id c-l-o-w-n"]
    words = toxicity.restored_words(hidden, letters)
    assert set(words["word"]) == {"stupid", "clown"} and set(words["text"]) == {0, 1, 2, 3, 4} - ({4} - set(words["text"]))
    model = toxicity.fit_toxic(docs, labels, letters)
    tests = frame(spark, [(i, t, None) for i, t in enumerate([*hidden[:4], "a nice day", "2024 numbers 12", None, ""])])
    score = {r.doc_id: r.score for r in toxicity.score_toxic(tests, letters, model).collect()}
    assert min(score[i] for i in range(4)) >= toxicity.CUT > max(score[i] for i in range(4, 8))


def test_toxicity_parts_words_set_apart(spark):
    docs, labels = labelled(spark)
    letters = toxicity.fit_letters(docs)
    hidden = ["a s t u p i d one", "y c l o w n", "s t u p i d c l o w n", "a  s t u p i d  c l o w n", "w h a t  a s.t.u.p.1.d"]
    words = toxicity.restored_words(hidden, letters).groupby("text")["word"].agg(set).to_dict()
    for i, expected in enumerate([{"a", "stupid"}, {"clown"}, {"stupid", "clown"}, {"a", "stupid", "clown"}, {"what", "stupid"}]):
        assert expected <= words[i], hidden[i]
    model = toxicity.fit_toxic(docs, labels, letters)
    clean = ["a n i c e d a y", "w h a t  a  n i c e  d a y"]
    tests = frame(spark, [(i, t, None) for i, t in enumerate([*hidden, *clean])])
    score = {r.doc_id: r.score for r in toxicity.score_toxic(tests, letters, model).collect()}
    assert min(score[i] for i in range(5)) >= toxicity.CUT > max(score[5], score[6])


def test_toxicity_restores_doubled_letters(spark):
    docs, labels = labelled(spark)
    letters = toxicity.fit_letters(docs)
    hidden = ["stuupid", "sstupid", "STUPPIDD", "clownn", "a ccloown"]
    words = toxicity.restored_words(hidden, letters)
    assert words.values.tolist() == [[0, "stupid"], [1, "stupid"], [2, "stupid"], [3, "clown"], [4, "clown"]]
    rows = [(i, f"{ENGLISH} all hills will be well", None) for i in range(20)]
    honest = toxicity.fit_letters(docs.unionByName(frame(spark, rows)))
    assert toxicity.restored_words(["all hills will be well"], honest).empty
    model = toxicity.fit_toxic(docs, labels, letters)
    tests = frame(spark, [(i, t, None) for i, t in enumerate([*hidden, "all hills", "nnice daay"])])
    score = {r.doc_id: r.score for r in toxicity.score_toxic(tests, letters, model).collect()}
    assert min(score[i] for i in range(5)) >= toxicity.CUT > max(score[5], score[6])


@pytest.fixture(scope="module")
def letter_model(spark):
    docs, _ = labelled(spark)
    return toxicity.fit_letters(docs)


def path_cost(letters, model):
    """What the letter model says of a word: from two breaks to the break at its end."""
    points = [0, 0, *map(ord, letters), 0]
    return sum(model.cost(*points[k : k + 3]) for k in range(len(letters) + 1))


def ways(decoder, span, apart):
    """Every reading of a span: (what the channel costs, letters)."""
    for arcs in itertools.product(*decoder._arcs(span, apart)):
        yield sum(extra for _, extra in arcs), "".join(chr(letter) for letter, _ in arcs if letter)


@pytest.mark.parametrize("span", ["st1pid", "cl0wn", "stuupid", "$tup1d", "aab", "n1ce", "1l1", "cl00wn!", "d@y"])
def test_viterbi_finds_the_cheapest_of_all_readings(letter_model, span):
    decoder = toxicity.Decoder(letter_model)
    cost, best = min((extra + path_cost(word, letter_model), word) for extra, word in ways(decoder, span, False))
    (found,) = decoder._decode(span, False)
    assert found == best or path_cost(found, letter_model) - path_cost(best, letter_model) < 1e-9 + cost
    again = min(extra + path_cost(word, letter_model) for extra, word in ways(decoder, span, False) if word == found)
    assert again == pytest.approx(cost)


@pytest.mark.parametrize("span", ["a c l o", "y  o u b", "s t 1 p", "n.i c e"])
def test_words_set_apart_are_those_near_the_cheapest_of_all_readings(letter_model, span):
    decoder = toxicity.Decoder(letter_model)
    breaks = toxicity._breaks(span)
    totals = {}  # word: the cheapest reading of the whole span that it is part of
    for cut in itertools.product((False, True), repeat=len(breaks)):
        edges = [0, *(at + 1 for at, taken in zip(breaks, cut, strict=True) if taken), len(span)]
        parts = []
        for a, b in itertools.pairwise(edges):
            inner = span[a : b - 1] if b - 1 in breaks and b != len(span) else span[a:b]
            # the last character of a gap that breaks is paid for by the break
            paid = breaks.get(b - 1, 0.0) if b != len(span) else 0.0
            parts.append(min(((extra + path_cost(w, letter_model) + paid, w) for extra, w in ways(decoder, inner, True))))
        whole = sum(cost for cost, _ in parts)
        for _, word in parts:
            totals[word] = min(totals.get(word, np.inf), whole)
    best = min(totals.values())
    expected = {w for w, cost in totals.items() if cost <= best + toxicity.NEAR}
    assert set(decoder._decode(span, True)) == expected


def test_long_spans_set_apart_give_the_same_words_in_windows(letter_model, monkeypatch):
    rng = random.Random(9)
    span = "".join(rng.choice("stupidclown1ae") + rng.choice([" ", " ", "  ", "."]) for _ in range(300)) + "n"
    whole = toxicity.Decoder(letter_model)._decode(span, True)
    for window in (7, 64, 299):
        monkeypatch.setattr(toxicity, "WINDOW", window)
        assert toxicity.Decoder(letter_model)._decode(span, True) == whole


def test_a_long_text_of_letters_set_apart_takes_bounded_memory(letter_model, monkeypatch):
    """Four times as many letters need hardly more: the words of one window are held, and a cost for each letter."""
    monkeypatch.setattr(toxicity, "WINDOW", 128)
    peaks = []
    for times in (40, 160):  # 920 and 3,680 letters
        text = " ".join("stupid clown what a nice day".replace(" ", "") * times)
        decoder = toxicity.Decoder(letter_model)
        tracemalloc.start()
        words = decoder.words(text, True)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert {"stupid", "clown"} <= set(words)
        assert decoder.remembered.cache_info().currsize == 0  # and the span is not kept
    assert peaks[1] < 1.4 * peaks[0] < 6e6


def test_the_labelled_sample_is_read_once(spark):
    docs, labels = labelled(spark)
    letters = toxicity.fit_letters(docs)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")
    model = toxicity.fit_toxic(watched, labels, letters)
    assert len(model.chosen) and read.value == 60


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    letters = toxicity.fit_letters(frame(spark))
    model = toxicity.fit_toxic(docs, labels, letters)
    rows = toxicity.score_toxic(frame(spark), letters, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxic(empty(spark), letters, model).count() == 0
    nothing = toxicity.fit_letters(empty(spark))
    blank = toxicity.fit_toxic(empty(spark), no_labels(spark), nothing)
    assert all(r.score < toxicity.CUT for r in toxicity.score_toxic(frame(spark), nothing, blank).collect())


def test_toxicity_query(spark, sf_dir):
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    rows = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert right >= 0.9 * len(held)
    assert not any(r.predicted for r in held if toxic[r.doc_id] == 0)


def test_labels_outside_the_folds_are_not_learned(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    letters = toxicity.fit_letters(docs)
    keep = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    a, b = (toxicity.fit_toxic(docs, x.filter(keep), letters) for x in (labels, flipped))
    assert (a.chosen == b.chosen).all() and (a.weights == b.weights).all() and a.bias == b.bias
