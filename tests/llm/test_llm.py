"""Problems 8 to 10 against exact encoding, accounting and held-out labels; and their edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.tokens")
from tidemark.llm import language, mixing, tokens  # noqa: E402
from tidemark.llm.queries import queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
QUERIES = queries()


# Problem 8


def encode(text):
    enc, at, parts = tokens.encoder(tokens.DEFAULT_RANKS), 0, []
    for end in tokens.cut_points(text):
        parts.append((text[at:end], *tokens.encode_chunk(text[at:end], enc)))
        at = end
    assert "".join(p[0] for p in parts) == text
    return tokens.assemble(parts, enc)


PIECES = ["'", "l", "r", "e", "v", " ", "  ", "\n", "\t", "\r\n", " ", "1", "é", "日", "!", "<|endoftext|>", "🇦🇺", "'ll", "'re", "x" * 30, "s", "d", "word ", "\u0301", "\ufeff", "\x1c", "\x85", "\u3000", "\ua7ce", "\U000323b0"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.sampled_from([2, 3, 7]), st.sampled_from([3, 17, 4096]))
def test_assembled_ids_equal_whole_encoding(pieces, mean, greatest):
    held = tokens.MEAN, tokens.GREATEST, tokens.WINDOW
    tokens.MEAN, tokens.GREATEST, tokens.WINDOW = mean, greatest, 2
    try:
        text = "".join(pieces)
        assert encode(text) == tokens.encoder(tokens.DEFAULT_RANKS).encode_ordinary(text)
    finally:
        tokens.MEAN, tokens.GREATEST, tokens.WINDOW = held


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.sampled_from([2, 3, 7]), st.integers(0, 2**60))
def test_ids_are_exact_whichever_chunks_are_known(pieces, mean, known):
    held = tokens.MEAN, tokens.GREATEST, tokens.WINDOW
    tokens.MEAN, tokens.GREATEST, tokens.WINDOW = mean, 17, 2
    try:
        text, enc, at, own = "".join(pieces), tokens.encoder(tokens.DEFAULT_RANKS), 0, []
        for i, end in enumerate(tokens.cut_points(text)):
            if known >> (i % 60) & 1:
                own.append((at, end - at, tokens._pack(tokens.encode_chunk(text[at:end], enc))))
            at = end
        parts = tokens.parts_of(text, own)
        assert "".join(p[0] for p in parts) == text
        assert not parts or tokens.assemble(parts, enc) == enc.encode_ordinary(text)
    finally:
        tokens.MEAN, tokens.GREATEST, tokens.WINDOW = held


def test_chunks_and_their_hashes_do_not_depend_on_the_batch():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc dé日\n.") for _ in range(rnd.choice([0, 3, 16, 17, 400, 9000]))) for _ in range(60)] + ["\U000323b0" * 5000, "x" * 9000]
    of, starts, ends, h = tokens.cut(texts)
    for i, t in enumerate(texts):
        _, s, e, own = tokens.cut([t])
        assert (starts[of == i] == s).all() and (ends[of == i] == e).all() and (h[of == i] == own).all()
        assert "".join(t[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)) == t
        assert t[:1] == "\U000323b0" or (e - s <= tokens.GREATEST).all()
    seen = {}
    for i, a, b, x in zip(of.tolist(), starts.tolist(), ends.tolist(), h.tolist(), strict=True):
        assert seen.setdefault(x, texts[i][a:b]) == texts[i][a:b]


def test_filter_lets_every_repeated_chunk_through(spark):
    rnd = np.random.default_rng(3)
    once, often = rnd.integers(-(2**63), 2**63, 5000), rnd.integers(-(2**63), 2**63, 3000)
    rows = spark.createDataFrame([(int(x),) for x in [*once, *often, *often]], "h long")
    words = tokens.repeated_filter(rows)
    assert tokens.lets_through(words, often.view(np.uint64)).all()
    assert tokens.lets_through(words, once.view(np.uint64)).mean() < 0.01
    assert not tokens.repeated_filter(rows.filter("false")).any()


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FILTER_BITS", 64)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    enc = tokens.encoder(tokens.DEFAULT_RANKS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in tokens.encode_corpus(docs).collect()} == {d: enc.encode_ordinary(t) for d, t in texts.items()}


def test_rows_of_one_id_with_different_texts_are_kept_apart(spark):
    body = "".join(random.Random(8).choice("abcdefgh ,.") for _ in range(3000))
    rows = [(1, "first " + body), (1, body + " second"), (1, body + " second"), (2, body)]
    enc = tokens.encoder(tokens.DEFAULT_RANKS)
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((d, enc.encode_ordinary(t)) for d, t in rows)


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 50_000 + "b", "\n" * 50_000, "'" * 9_999 + "ll", "0123456789" * 20_000])
def test_texts_without_boundaries(text):
    assert encode(text) == tokens.encoder(tokens.DEFAULT_RANKS).encode_ordinary(text)


def test_equal_passages_give_equal_chunks():
    rnd = random.Random(2)
    body = "".join(rnd.choice("abcdefgh ,.") for _ in range(20_000))

    def chunks(t):
        ends = tokens.cut_points(t)
        return {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    one, two = chunks("short start " + body), chunks("another, rather different start " + body)
    assert len(one & two) > 0.9 * len(one)


def test_query_is_exact_and_defined_for_empty_and_null(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: list(r.ids) for r in QUERIES["p8_ids"](spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        assert got[doc] == (other.encode(text, add_special_tokens=False).ids if text else [])


def test_encoding_repeated_rows_and_markers(spark):
    rows = [(1, "<|endoftext|> is text"), (1, "<|endoftext|> is text"), (2, ""), (3, None), (4, " ")]
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string")).collect()}
    enc = tokens.encoder(tokens.DEFAULT_RANKS)
    assert got == {1: enc.encode_ordinary(rows[0][1]), 2: [], 3: [], 4: enc.encode_ordinary(" ")}
    assert 50256 not in got[1]


# Problem 9


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mix_meets_targets_within_caps(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["A ", "a", "b", "c", None, "other"]), rnd.choice([0, 1, 5, 40, 200, None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    told = targets(spark, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("missing", 0.0, 3)])
    mixed = mixing.mix(docs, told).collect()
    caps, size = {"a": 1, "b": 4, "c": 2}, {r[0]: r[2] for r in rows}
    assert len({r.doc_id for r in mixed}) == len(mixed)
    assert all(1 <= r.copies <= caps[r.source] and size[r.doc_id] for r in mixed)
    got = {r.source: r.actual_share for r in mixing.shares(mixing.mix(docs, told), told).collect()}
    assert got["a"] == pytest.approx(0.5, abs=0.002) and got["b"] == pytest.approx(0.3, abs=0.002) and got["c"] == pytest.approx(0.2, abs=0.002) and got["missing"] == 0
    assert {(r.doc_id, r.copies) for r in mixed} == {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7), told).collect()}


def test_mix_is_the_largest_feasible(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)], "doc_id long, source string, n_tokens long")
    mixed = mixing.mix(docs, targets(spark, [("a", 0.5, 1), ("b", 0.5, 3)])).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()
    assert {r.source: r.t for r in mixed} == {"a": 300, "b": 300}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x", 10), (2, None, 5)], "doc_id long, source string, n_tokens long")
    told = targets(spark, [("a", 1.0, 2)])
    assert mixing.mix(docs, told).collect() == []
    assert [(r.source, r.actual_share) for r in mixing.shares(mixing.mix(docs, told), told).collect()] == [("a", 0.0)]


def test_pareto_inclusion_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, source string, n_tokens long, weight double")
    other = spark.createDataFrame([(10_000 + i, "b", 10, 1.0) for i in range(1000)], "doc_id long, source string, n_tokens long, weight double")
    mixed = mixing.mix(docs.unionByName(other), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])).filter("source = 'a'").collect()
    heavy = sum(r.doc_id % 2 for r in mixed)
    assert len(mixed) == 1000 and 2.3 < heavy / (1000 - heavy) < 3.9


def test_scale_solves_for_the_quota_with_certain_units():
    rnd = random.Random(6)
    for _ in range(30):
        units = [(rnd.choice([1.0, 2.0, 8.0, 400.0]), rnd.randrange(1, 50)) for _ in range(rnd.choice([1, 5, 200]))]
        bins = {}
        for w, n in units:
            b = int(np.floor(np.log2(w) * mixing.FINE))
            t, x = bins.get(b, (0, 0.0))
            bins[b] = (t + n, x + n * w)
        rest = rnd.random() * sum(n for _, n in units) * 0.98
        c = mixing.scale([(b, t, x) for b, (t, x) in bins.items()], rest)
        assert sum(min(1.0, c * w) * n for w, n in units) == pytest.approx(rest, rel=1e-6)
    assert mixing.scale([], 5.0) == mixing.scale([(0, 10, 10.0)], 0.0) == 0.0


def test_inclusion_rates_are_p(spark):
    """Weights 1, 2 and 5 and some that are certain: each class is drawn at its own p, and the size is fixed."""
    kinds = [1.0, 2.0, 5.0, 5000.0]
    rows = [(i, "a", 10, kinds[3] if i % 100 == 0 else kinds[i % 3]) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double").unionByName(spark.createDataFrame([(10**6 + i, "b", 10, 1.0) for i in range(6000)], "doc_id long, source string, n_tokens long, weight double"))
    took = {r.doc_id for r in mixing.mix(docs, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])).filter("source = 'a'").collect()}
    assert len(took) == 6000  # the quota of a is the whole of b
    per = {k: [r[0] in took for r in rows if r[3] == k] for k in kinds}
    assert all(per[5000.0])
    c = (6000 - len(per[5000.0])) / sum(k * len(per[k]) for k in kinds[:3])
    for k in kinds[:3]:
        p, n = c * k, len(per[k])
        assert abs(sum(per[k]) / n - p) < 4 * (p * (1 - p) / n) ** 0.5


def test_larger_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "a", 10 if i % 2 else 30) for i in range(8000)] + [(10**6 + i, "b", 10) for i in range(4000)], "doc_id long, source string, n_tokens long")
    took = mixing.mix(docs, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])).filter("source = 'a'").collect()
    large = sum(r.n_tokens == 30 for r in took)
    assert sum(r.n_tokens for r in took) == 40_000 and 2.6 < large / (len(took) - large) < 3.4


def test_a_huge_document_does_not_block_a_source(spark):
    rnd = random.Random(9)
    rows = [(1, "a", 1_000_000), (2, "a", 6_000)] + [(i, "a", rnd.randrange(1, 90)) for i in range(3, 900)] + [(10**6, "b", 10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for seed in range(3):
        took = mixing.mix(docs, targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), seed).filter("source = 'a'").collect()
        assert abs(sum(r.n_tokens for r in took) - 10_000) <= 2 and 1 not in {r.doc_id for r in took}


def test_equal_ranks_and_one_document(spark):
    docs = spark.createDataFrame([(7, "a", 50)], "doc_id long, source string, n_tokens long")
    assert [(r.doc_id, r.copies) for r in mixing.mix(docs, targets(spark, [("a", 1.0, 3)])).collect()] == [(7, 3)]


# Problem 10


@pytest.fixture(scope="module")
def samples(spark):
    return [(r.lang, r.sample_text) for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").collect()]


def test_held_out_sentences(samples):
    held = [s for i, s in enumerate(samples) if i % 4 == 0]
    filters = language.Filters.fit([s for i, s in enumerate(samples) if i % 4])
    found = language.judge([t for _, t in held], filters)
    right = sum(bool(f) and f[0][1] == lang for f, (lang, _) in zip(found, held, strict=True))
    assert right / len(held) > 0.93
    known = [(f[0][1], lang) for f, (lang, _) in zip(found, held, strict=True) if f]
    assert all(a == b for a, b in known)


def test_no_false_negatives_and_false_positive_rate(samples):
    filters = language.Filters.fit(samples)
    for bit, lang in enumerate(filters.langs):
        folded, _ = language._letters("\n".join(language._NOISE.sub(" ", t) for g, t in samples if g == lang))
        h, _ = language._grams(folded, 4)
        assert ((filters.masks(h) >> np.uint64(bit)) & np.uint64(1)).all()
    strange = np.random.default_rng(1).integers(0, 2**63, 200_000, dtype=np.uint64)
    seen = np.array([((filters.masks(strange) >> np.uint64(b)) & np.uint64(1)).mean() for b in range(len(filters.langs))])
    assert (np.abs(seen - filters.false) < 5e-4).all()


def test_more_than_sixty_four_languages():
    rnd = random.Random(12)
    made = {}
    for i in range(150):
        letters = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)]
        made[f"l{i:03d}"] = ["".join(rnd.choice([*letters, " "]) for _ in range(400)) for _ in range(3)]
    filters = language.Filters.fit([(g, t) for g, ts in made.items() for t in ts[:2]])
    assert filters.words.shape[1] == 3 and (filters.false <= language.FALSE_RATE).all()
    found = language.judge(["".join(ts[0][:300]) for ts in made.values()], filters)
    assert [f[0][1] for f in found] == list(made)


def test_slots_follow_from_the_ngrams_found(samples):
    """Ten times the text, more slots: the false-positive rate stays where it is."""
    rnd = random.Random(13)
    few = language.Filters.fit(samples)
    many = language.Filters.fit(samples + [("en", " ".join("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(20_000)))])
    assert len(many.words) > len(few.words) and many.false.max() <= language.FALSE_RATE and few.false.max() <= language.FALSE_RATE


def test_fit_on_executors_equals_fit_on_the_driver(spark, samples):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    aliases = {r[0].strip().lower(): r[1].strip().lower() for r in spark.read.parquet(f"{DATA}/lang_aliases.parquet").select("alias", "lang").collect() if r[0] and r[1]}
    got = language.fit_filters(spark.read.parquet(f"{DATA}/lang_samples.parquet"), docs.repartition(5), aliases)
    first = language.Filters.fit(sorted(samples))
    words = language._blank(len(first.langs))
    language._mark_all(words, first.langs, sorted(samples))
    for r in docs.filter("text is not null").collect():
        g = aliases.get((r.lang or "").strip().lower())
        if g in first.langs:
            language._mark(words, first.langs.index(g), "\n".join(language._confirmed(r.text, first.langs.index(g), first)))
    want = language.Filters.of(first.langs, words)
    assert got.langs == want.langs and np.array_equal(got.words, want.words)


def test_lines_quotes_codes_and_stripped_accents(samples):
    filters = language.Filters.fit(samples)
    de, en, fr = (next(t for g, t in samples if g == lang and len(t) > 60) for lang in ("de", "en", "fr"))
    text = f"{de}\r\n \ntxn-1 | 2.5 | 2026-07-02T10:12Z\n{en}\n\n{{\"id\": 1, \"v\": [2]}}\n<|endoftext|>\n{de} \"{fr[:30]}\"\n{fr.upper()}\n½ ² ™ €"
    found = {n: lang for n, lang, _, _ in language.judge([text], filters)[0]}
    assert found == {1: "de", 3: "en", 6: "de", 7: "fr"}
    plain = "".join(c for c in __import__("unicodedata").normalize("NFD", fr) if not "̀" <= c <= "ͯ")
    assert language.judge([plain.lower()], filters)[0][0][1] == "fr"
    assert language.judge([None, "", " \n\t", "12 34", "acct-1 >> merchant-2"], filters) == [[], [], [], [], []]


def test_long_text_is_judged_whole(samples):
    filters = language.Filters.fit(samples)
    en, ja = (next(t for g, t in samples if g == lang) for lang in ("en", "ja"))
    text = "\n".join([en] * 20_000 + [ja])
    found = language.judge([text, en], filters)
    assert len(found[0]) == 20_001 and found[0][-1][1] == "ja" and found[1][0][1] == "en"


def test_query_agrees_with_labels_that_name_the_language(spark):
    found = QUERIES["p10_languages"](spark, DATA).filter("seg_no = 0 and lang is not null")
    names = spark.read.parquet(f"{DATA}/lang_aliases.parquet").select(F.lower(F.trim("alias")).alias("a"), F.col("lang").alias("named"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.lower(F.trim("lang")).alias("a")).join(names, "a")
    both = found.join(docs, "doc_id")
    assert both.filter("lang = named").count() > 0.85 * both.count()
    assert both.filter("confidence < 0 or confidence > 1").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_dirty_tables(spark, empty_tables, dirty_tables, name):
    out = QUERIES[name](spark, empty_tables)
    assert name == "p9_shares" or out.count() == 0
    assert QUERIES[name](spark, dirty_tables).count() > 0
