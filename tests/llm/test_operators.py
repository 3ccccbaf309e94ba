"""The ten operators against plain versions, on test data and on awkward rows."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parley.llm import bpe, components, decontaminate, fertility, kneser_ney, langid, pii, queries, secrets, sentence_dedup, simhash, suffix_dedup

from ..conftest import SF001, SF01
from . import plain

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# ---- BPE

def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_bpe_equals_the_library():
    with open(VOCABULARY, encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    library, rng = _library(), random.Random(1)
    some = "abcdefghijklmnopqrstuvwxyz  'éß0123456789.,!?\n\t-=<>{}$日本🙂  "
    texts = ["".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in [*range(0, 0xD800, 11), *range(0xE000, 0x30000, 29)]]
    texts += [t or "" for _, t in plain.AWKWARD] + ["a" * 3000, "<|endoftext|>x<|endoftext|><|endo", " " * 100]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == ids, t
        assert codec.decode(codec.encode(t)) == library.decode(ids, skip_special_tokens=False), t


def test_bpe_query(spark, docs):
    library = _library()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op9_bpe_codec(spark, SF001).collect()}
    assert len(found) == len(docs)
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[i] == (len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_decode_column_and_awkward(spark):
    made = bpe.decode(bpe.encode(plain.awkward(spark), VOCABULARY), VOCABULARY).select("text", "decoded", "score").collect()
    assert len(made) == len(plain.AWKWARD) and all((r["text"] or "") == r["decoded"] for r in made)
    broken = bpe.decode(spark.createDataFrame([(bytearray(np.array([162], "<u4").tobytes()),), (None,)], "token_ids binary"), VOCABULARY)
    assert [r["decoded"] for r in broken.collect()] == ["�", ""]


# ---- SimHash

def test_simhash_query(spark, docs):
    prints = {i: plain.simhash(t) for i, t in docs}
    roots = plain.groups(prints.values())
    low = {}
    for i, f in prints.items():
        low[roots[f]] = min(i, low.get(roots[f], i))
    found = [tuple(r) for r in queries.op8_simhash_golay(spark, SF001).collect()]
    assert ordered(found) == ordered((i, f"{f:016x}", low[roots[f]]) for i, f in prints.items())


def test_golay_table_corrects_three_errors():
    table, rng = simhash.syndromes(), np.random.default_rng(1)
    index = rng.integers(0, 1 << 12, 200)
    base = index << 11
    code = base ^ simhash.remainder(base)
    assert (simhash.remainder(code) == 0).all() and len(set(table.tolist())) == 1 << 11
    for n in range(4):
        noise = np.array([sum(1 << int(b) for b in rng.choice(23, n, replace=False)) for _ in code])
        assert (simhash.decoded(code ^ noise, table) == index).all()


@pytest.mark.parametrize("paired", [0, 2, 24])
def test_links_find_every_near_pair(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(3)
    values = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(rng.choice([0, 1, 3, 30])):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 1, 2, 3]))))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    roots = components.components(simhash.links(spark.createDataFrame(signed, "fp bigint")))
    got = {r["vertex"] % (1 << 64): r["root"] for r in roots.collect()}
    want = plain.groups(values)
    size = collections.Counter(want.values())
    assert set(got) == {v for v in values if size[want[v]] > 1}
    parts = lambda x: sorted(sorted(v for v in x if x[v] == r) for r in set(x.values()))
    assert parts(got) == parts({v: r for v, r in want.items() if size[r] > 1})


def test_simhash_awkward(spark):
    found = simhash.near_duplicates(plain.awkward(spark)).select("doc_id", "fp", "component_id", "score").collect()
    assert len(found) == len(plain.AWKWARD)
    same = {r["fp"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert same == {0} and {r["component_id"] for r in found if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(plain.awkward(spark, [])).count() == 0
    only = simhash.near_duplicates(frame(spark, [(None, "a b c d"), (None, "a b c d")])).collect()
    assert [r["component_id"] for r in only] == [None, None] and len({r["component_fp"] for r in only}) == 1


# ---- language

def test_language_query_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    found = queries.op3_language_zstd(spark, SF01).collect()
    assert len(found) == len(lang) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert 100 < len(held) < 300
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in found) <= 0.02 * len(found)


def test_language_is_learned_from_other_folds_only(spark):
    rows = [(i, f"{'uno dos tres' if i % 2 else 'one two three'} {i}", "xx" if i % 2 else "yy") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r["doc_id"] for r in df.where(langid.held_out()).collect()}
    seen = langid.learn(df.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang"))))
    assert out and set(seen) == {"xx", "yy"}


def test_language_awkward(spark):
    found = langid.identify(plain.awkward(spark)).collect()
    assert len(found) == len(plain.AWKWARD)
    for r in found:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert langid.identify(plain.awkward(spark, [])).count() == 0


# ---- decontamination

@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 2000])
def test_decontamination(spark, docs, block):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    items += [(None, "hello world"), (900, ""), (901, None), (902, "tie tie tie"), (902, "Lorem  ipsum")]
    rows = docs[:120] + plain.AWKWARD + [(50, f"x {items[0][1]} y"), (51, f"{items[1][1]} {items[2][1]}")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(plain.awkward(spark, rows), bench, block_bytes=block)
    got = [tuple(r) for r in decontaminate.digests(found).collect()]
    assert ordered(got) == ordered((i, *x) for (i, _), x in zip(rows, plain.contaminated(rows, items)))


def test_benchmark_blocks_hold_what_is_stated(spark, monkeypatch):
    rng, sizes, mark = random.Random(3), [], decontaminate._mark
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(60)]
    large = (99, " ".join(word() for _ in range(200)))
    rows = items + [items[0]] * 200 + [large, (None, None), (98, None)]
    monkeypatch.setattr(decontaminate, "_mark", lambda docs, part, *a: sizes.append(part) or mark(docs, part, *a))
    bench, docs = spark.createDataFrame(rows, "item_id bigint, text string"), frame(spark, [(1, items[0][1]), (2, f"x {items[7][1]}"), (3, large[1]), (4, "x")])
    found = {r["doc_id"]: r["items"] for r in decontaminate.contamination(docs, bench, block_bytes=1000).collect()}
    assert found == {1: ["0"], 2: ["7"], 3: ["99"], 4: []}
    assert all(len(part) == 1 or sum(len(t or "") for _, t in part) <= 1000 for part in sizes)
    assert sum(map(len, sizes)) == len(items) + 3 and len(sizes) < 25


def test_decontamination_query_and_empty(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op5_prefix_decontamination(spark, SF001).collect()]
    assert ordered(got) == ordered((i, *x) for (i, _), x in zip(docs, plain.contaminated(docs, items)))
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(frame(spark, [(1, "a b")]), none).first()["contaminated"] is False
    assert decontaminate.contamination(plain.awkward(spark, []), none).count() == 0


# ---- personal data, secrets

PIECES = ["a", "b1", "@", "@x.", ".", " ", "-", "+1", "(555)", "123", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "0001", "a@b.c", "_x@d.e", "é", "🙂",
          "token", "password", '"', "'", "=", ":", "AKIA", "ABCDEF0123456789", "deadbeef" * 5, "api_key", "\n", "aB3xQ9zL0pR7tY2wK5mN"]


@pytest.mark.parametrize("module, kinds", [(pii, plain.PII), (secrets, plain.SECRETS)])
def test_base_spans(spark, docs, module, kinds):
    rng = random.Random(5)
    rows = docs + plain.AWKWARD + [(100_000 + k, "".join(rng.choices(PIECES, k=rng.randint(1, 25)))) for k in range(1500)]
    found = module.digests(module.detect(frame(spark, rows))).collect()
    n = len(kinds) + 2
    assert ordered(tuple(r)[:n] for r in found) == ordered((i, *plain.base_spans(t, kinds)) for i, t in rows)
    assert module.detect(plain.awkward(spark, [])).count() == 0
    assert module.detect(plain.awkward(spark)).count() == len(plain.AWKWARD)


def test_pii_adds_spans_and_redacts(spark):
    rows = [(i, f"please call me at 555-123-{1000 + i} today, ssn 123-45-{6000 + i} or mail joe{i}@example.com now") for i in range(30)]
    rows += [(100 + i, f"see section 4{i}-22-1{i:03d} of version 1.2.3.{i}") for i in range(10)]
    found = pii.detect(frame(spark, rows))
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(found).collect()}
    assert all("tel:" in spans[i] and "email:" in spans[i] for i in range(30))
    text = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert text[3].startswith("please call me at [TEL] today") and text[3].endswith("mail [EMAIL] now")


def test_secret_entropy(spark):
    rng = random.Random(2)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    rows = [(1, f"use {key} here"), (2, "use aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 here"), (3, "123e4567-e89b-12d3-a456-426614174000"), (4, f"EXAMPLE{key}")]
    found = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.detect(frame(spark, rows))).collect()}
    assert found == {1: "entropy:4:44", 2: "", 3: "", 4: ""}


def test_sliding_entropy_equals_every_window(spark):
    import math

    rng, w = random.Random(4), secrets.WINDOW
    values = ["".join(rng.choices("abcDEF0123+/", k=rng.randint(w, 70))) for _ in range(50)]

    def highest(v):
        return max(-sum(c / w * math.log2(c / w) for c in collections.Counter(v[i : i + w]).values()) for i in range(len(v) - w + 1))

    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.entropy(F.col("v")).alias("e")).collect()
    assert all(abs(r["e"] - highest(r["v"])) < 1e-9 for r in got)


# ---- quality by fertility

def test_fertility(spark, docs):
    rows = docs + plain.AWKWARD
    path = public_tokenizers.path
    found = fertility.quality(plain.awkward(spark, rows), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = found.select(*names, "kept", "byte_share", "entropy", "chars_per_piece").collect()
    assert ordered(tuple(r)[:7] for r in got) == ordered((i, *plain.base_quality(t)) for i, t in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert sum(r["kept"] for r in got) > 0.9 * sum(not r["base_failed"] for r in got)
    assert queries.op6_tokenizer_fertility(spark, SF001).count() == len(docs)


def test_fertility_measures():
    path = public_tokenizers.path
    files = [open(path(n), "rb").read() for n in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    tokens = fertility.Tokenisers(*files, public_tokenizers.PATTERN)
    words = "the quick brown fox \U00012000\U00012000".encode().split()
    per_piece, per_token, share, entropy, part = fertility.measures(words, 18, tokens)
    ids = [i for w in words for i in tokens.pieces.encode(w.decode())]
    count = collections.Counter(ids)
    assert per_piece == 18 / len(ids) and share == sum(tokens.pieces.is_byte(i) for i in ids) / len(ids) > 0
    assert abs(entropy + sum(c / len(ids) * np.log2(c / len(ids)) for c in count.values())) < 1e-9 and 0 < part <= 1
    assert fertility.script("привет мир") == "Cyrillic" and fertility.script("Straße") == "Latin" and fertility.script("12") == "other"


def test_fertility_bands_come_from_the_corpus(spark):
    rng, path = random.Random(8), public_tokenizers.path
    common = "the people of this town have many old houses and some new ones near a long river where boats go by every day in summer and winter".split()
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(80, 160))), "en" if i % 2 else None) for i in range(2 * fertility.LEAST_TEXTS)]
    odd = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(100))  # no longer words, only more tokens for each
    rows += [(1000, odd, "en"), (1001, odd, None), (1002, odd, "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    files = path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    fixed = {r["doc_id"]: r["kept"] for r in fertility.measured(docs, *files).collect()}
    assert all(fixed.values())  # no fixed band tells them apart
    for frame_ in (docs, docs.drop("lang")):
        kept = {r["doc_id"]: r["kept"] for r in fertility.quality(frame_, *files).collect()}
        assert len(kept) == len(rows) and not any(kept[i] for i in (1000, 1001, 1002)) and sum(kept.values()) >= len(rows) - 5
    few = {r["doc_id"]: r["kept"] for r in fertility.quality(docs.where("doc_id < 20 or doc_id >= 1000"), *files).collect()}
    assert all(few.values())


# ---- sentence spans

def test_sentence_spans(spark, docs):
    rows = docs + [(10_000 + i, "one two three. four five six! seven\neight nine. ten.") for i in range(3)]
    places = collections.defaultdict(list)
    for i, t in rows:
        for at, n, d in sentence_dedup.runs(t):
            places[d].append((i, at, n))
    gone = collections.defaultdict(set)
    for p in places.values():
        for i, at, n in sorted(p)[1:]:
            gone[i] |= set(range(at, at + n))
    found = sentence_dedup.dedup(frame(spark, rows).repartition(5)).collect()
    assert {r["doc_id"]: set(r["removed"]) for r in found} == {i: gone[i] for i, _ in rows}
    for r in found:
        ends = sentence_dedup.sentences(r["text"])
        assert r["kept_text"] == "".join(r["text"][a:b] for k, (a, b) in enumerate(zip([0, *ends], ends)) if k not in gone[r["doc_id"]])
    assert {r["doc_id"]: r["n_removed"] for r in found}[10_000] == 0 and {r["doc_id"]: r["n_removed"] for r in found}[10_002] == 5


def test_passages_of_over_fifty_words_are_caught(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    def passage(lengths):
        return " ".join(" ".join(word() for _ in range(n)) + "." for n in lengths)
    for lengths in ([60], [30, 25], [20, 20, 20], [6] * 9, [45, 6]):
        same = passage(lengths)
        rows = [(i, f"{passage([8, 9])}\n{same}\n{passage([7])}") for i in range(3)]
        found = {r["doc_id"]: r["kept_text"] for r in sentence_dedup.dedup(frame(spark, rows)).collect()}
        assert same in found[0] and all(found[i].count(".") == 3 for i in (1, 2)), lengths


def test_passages_inside_sentences_are_caught(spark):
    rng, edge = random.Random(4), sentence_dedup.SPREAD - 1
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    rows, copied = [], {}
    for k in range(40):
        same = words(rng.choice([51, 55, 63, 120]))
        for i in (10 * k, 10 * k + 1, 10 * k + 2):
            comma = [w + "," if j % 7 == 3 else w for j, w in enumerate(same)]
            rows.append((i, " ".join([*words(9), "end.", *words(rng.randint(1, 30)), *comma, *words(rng.randint(1, 30)), "end."])))
            copied[i] = comma
    found = {r["doc_id"]: r["kept_text"].split() for r in sentence_dedup.dedup(frame(spark, rows)).collect()}
    for i, text in rows:
        kept, all_words, same = found[i], text.split(), copied[i]
        if i % 10 == 0:
            assert kept == all_words
        else:
            at = all_words.index(same[0])
            assert kept[:at] == all_words[:at] and kept[-(len(all_words) - at - len(same)) :] == all_words[at + len(same) :]
            left = kept[at : len(kept) - (len(all_words) - at - len(same))]
            n = max((j for j in range(len(left) + 1) if left[:j] == same[:j]))
            assert len(left) <= 2 * edge and n <= edge and left[n:] == same[len(same) - len(left) + n :]


def test_chosen_strings_are_least_of_their_neighbours():
    rng, p, w = random.Random(6), sentence_dedup.PASSAGE, sentence_dedup.SPREAD
    words = [b"%d" % rng.randrange(50) for _ in range(700)]
    whole = {tuple(words[i : i + p]) for i in sentence_dedup.chosen(words)}
    for at in range(0, 640, 7):
        part = words[at : at + p + w - 1]
        assert [tuple(part[i : i + p]) in whole for i in sentence_dedup.chosen(part)] == [True]
    assert max(np.diff(sentence_dedup.chosen(words))) <= w and sentence_dedup.chosen(words[: p + w - 2]) == []


def test_sentences_are_cut_once(spark, docs, monkeypatch):
    rows = [*docs[:40], docs[0], (None, docs[1][1]), (90_000, "\u00e9 \U0001f600!  \n\n b."), (90_001, " \n "), (90_002, "a" * 1000 + "\nb\n" + "c" * 254 + "\n" + "d" * 253 + "\n"), (90_004, ""), (90_003, None)]
    base = frame(spark, rows).withColumn("mark", F.xxhash64("text")).select("doc_id", "mark", "text").repartition(3)
    sizes = {(r["doc_id"], r["mark"]): r["sizes"] for r in sentence_dedup._places(base).where("sizes is not null").collect()}
    texts = {(r["doc_id"], r["mark"]): r["text"] for r in base.collect() if r["text"]}
    assert {k: sentence_dedup._ends(v) for k, v in sizes.items()} == {k: sentence_dedup.sentences(t) for k, t in texts.items()}

    def again(text):
        raise AssertionError("cut a second time")

    monkeypatch.setattr(sentence_dedup, "sentences", again)
    assert sentence_dedup._without("One. Two. Three.", [1 << 32 | 1], b"\5\5\6") == ("One. Three.", 3, 1, [1])
    assert sentence_dedup._without("One. Two.", None, b"\5\4") == ("One. Two.", 2, 0, []) and sentence_dedup._without(None, None, None) == (None, 0, 0, [])
    monkeypatch.undo()
    assert sentence_dedup._without("One. Two. Three.", None, b"\5\4") == ("One. Two. Three.", 3, 0, [])  # sizes of another text


def test_sentence_spans_awkward(spark):
    found = sentence_dedup.dedup(plain.awkward(spark)).collect()
    assert len(found) == len(plain.AWKWARD)
    assert sentence_dedup.dedup(plain.awkward(spark, [])).count() == 0
    assert queries.op1_sentence_spans(spark, SF001).count() == 200


# ---- repeated bytes

def test_singer_sets_cover_all_differences():
    for q in (2, 3, 5, 7, 17):
        v, cover = suffix_dedup.singer(q)
        assert v == q * q + q + 1 and len(cover) == q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rng = random.Random(seed)
    source = "".join(rng.choices("abcdefgh é", k=6000))
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, "x" * 400), (5, "y" * 401), (6, "ab" * 3000), (None, source[:700]), (7, source[:700]), (8, source[900:1500]), (8, source[900:1500]), (None, source[:700])]
    for i in range(50):
        text = ""
        for _ in range(rng.randint(1, 6)):
            a = rng.randrange(5000)
            text += source[a : a + rng.choice([50, 300, 398, 399, 400, 401, 405, 430, 456, 457, 500, 800])] + "".join(rng.choices("xyzw", k=rng.choice([0, 1, 3, 60])))
        rows.append((rng.choice([10 + i, None, 10]), text))
    found = suffix_dedup.dedup(frame(spark, rows).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert ordered(map(tuple, found.collect())) == ordered(plain.repeated_bytes(rows))


def test_repeated_bytes_query_and_awkward(spark, docs, monkeypatch):
    found = queries.op4_difference_cover(spark, SF001).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert ordered(map(tuple, found.collect())) == ordered(plain.repeated_bytes(docs))
    rows = [(i, t) for i, t in plain.AWKWARD if t != plain.LONG and t != plain.LONG + "x"] + [(8, plain.LONG[:9000])]
    odd = suffix_dedup.dedup(plain.awkward(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert ordered(map(tuple, odd.collect())) == ordered(plain.repeated_bytes(rows))
    assert suffix_dedup.dedup(plain.awkward(spark, [])).count() == 0


def test_segments_do_not_change_names():
    raw = np.frombuffer(plain.LONG[:5000].encode(), np.uint8)
    at, h = np.arange(0, 4600, 7), suffix_dedup.Hasher()
    whole, small = h.windows(raw, at, 56, 400, 1), None
    segment, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, 513
    try:
        small = h.windows(raw, at, 56, 400, 1)
    finally:
        suffix_dedup.SEGMENT = segment
    assert (whole == small).all()


# ---- Kneser-Ney

def test_kneser_ney(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    words = collections.Counter(w for i in trusted for w in texts[i].split())
    model = plain.KneserNey(words)
    for h in ("", "e", "\x02th"):
        assert abs(sum(model.p(h, c) for c in [g for g in model.count if len(g) == 1] + [""]) - 1) < 1e-9
    found = queries.op10_kneser_ney(spark, SF001).collect()
    assert len(found) == len(texts)
    for r in found[::5]:
        assert abs(model.perplexity(texts[r["doc_id"]]) - r["perplexity"]) < 1e-6 * r["perplexity"]
        assert r["kept"] == (r["perplexity"] <= r["threshold"])
    table = kneser_ney.train(rows.join(spark.createDataFrame([(i,) for i in trusted], "doc_id bigint"), "doc_id", "left_semi"))
    one, many = ({r["doc_id"]: r["log_p"] for r in kneser_ney.log_probability(rows, table, shard_rows=n).collect()} for n in (10**6, 4000))
    assert all(abs(one[i] - many[i]) < 1e-6 * abs(one[i]) for i in one)


def test_kneser_ney_holds_one_shard_in_a_stage(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").limit(40)
    table = kneser_ney.train(rows)
    found = kneser_ney.log_probability(rows, table, shard_rows=table.count() // 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    whole = {r["doc_id"]: (r["log_p"], r["n_scored"]) for r in kneser_ney.log_probability(rows, table).collect()}
    got = {r["doc_id"]: (r["log_p"], r["n_scored"]) for r in found.collect()}
    assert len(got) == 40 and all(got[i][1] == n and abs(got[i][0] - p) < 1e-6 * abs(p) for i, (p, n) in whole.items())


def test_kneser_ney_awkward(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (8, None), (None, 1)], "doc_id bigint, quality int")
    found = kneser_ney.classify(plain.awkward(spark), labels).collect()
    assert len(found) == len(plain.AWKWARD)
    assert all((r["perplexity"] is None) == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["n_chars"] is None) for r in found)
    empty = labels.limit(0)
    untrained = kneser_ney.classify(plain.awkward(spark), empty).collect()
    assert {r["kept"] for r in untrained if r["doc_id"] == 4} == {True} and {r["kept"] for r in untrained if r["doc_id"] == 2} == {False}
    assert kneser_ney.classify(plain.awkward(spark, []), labels).count() == 0
