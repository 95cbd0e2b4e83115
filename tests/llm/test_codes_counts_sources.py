"""Vector codes, token counts and source divergence against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from varsparq.llm import divergence, tokencounts, vectorcodes
from varsparq.storage import table_path

public_tokenizers = pytest.importorskip("public_tokenizers")


def codes_by_hand(rows, parts, entries, rounds):
    """The definition, one vector at a time: rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(cut(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(cut(v, p), books[p])[0]].append(cut(v, p))
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [(i, [near(cut(v, p), books[p]) for p in range(parts)], lab) for i, v, lab in kept]
    label = Counter()
    for _, found, lab in out:
        label[lab] += sum(d for _, d in found)
    return sorted((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label[lab], sha) for i, found, lab in out)


def test_vector_codes_are_the_definition(spark):
    draw = random.Random(5)
    middles = [[draw.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [m + draw.gauss(0, 0.1) for m in middles[i % 6]], None if i % 7 == 0 else 1 if i % 2 else 2) for i in range(3, 400)]
    rows += [(k, rows[0][1], 1) for k in range(1000, 1200)]  # a group of copies: ties between equal entries
    rows += [(0, None, 1), (1, [1.0, None] + [0.0] * 6, 1), (2, [float("nan")] * 8, 1), (401, [float("inf")] + [0.0] * 7, 2), (402, [-0.5] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = vectorcodes.vector_codes(df.repartition(5), parts=4, entries=16, rounds=4)
    assert sorted(tuple(r) for r in got.collect()) == codes_by_hand(plain, 4, 16, 4)


def test_vector_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error long"
    none = spark.createDataFrame([], schema)
    assert vectorcodes.vector_codes(none).count() == 0
    assert vectorcodes.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    odd = [(5, [1.0, 2.0, 3.0, 4.0], 1, "x", 9), (6, [1.0, 2.0], 1, "x", 9), (7, [], 1, "x", 9), (4, [1.0, 2.0, 3.0], 1, "x", 9), (None, [1.0, 2.0, 3.0, 5.0], None, "x", 9), (5, [1.0, 2.0, 3.0, 4.0], 1, "x", 9)]
    got = sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in vectorcodes.vector_codes(spark.createDataFrame(odd, schema)).collect())
    # ids 4, 6 and 7 have lengths that can't be cut in 4 or differ; the two equal rows share entry 0, so entry 1 is unused
    assert got == [(0, "00000002", 0, 0), (5, "00000000", 0, 0), (5, "00000000", 0, 0)]
    huge = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1, "x", 9)], schema)
    with pytest.raises(Exception, match="too large"):
        vectorcodes.vector_codes(huge).collect()


TEXTS = [None, "", "one", "Two words", "Two words", "ein Text mit <|endoftext|> darin", "x" * 30_000, "žluťoučký kůň 漢字   end", "a  b\n\n c\t", "Two words"]


def plain_counts(texts, vocabulary):
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_the_library(spark, name):
    vocabulary = str(public_tokenizers.path(name))
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id or 0: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(df, vocabulary, limit=5).collect()}
    counts = plain_counts(TEXTS, vocabulary)
    assert got == {i: (len((t or "").encode()), n, n > 5) for i, (t, n) in enumerate(zip(TEXTS, counts, strict=True))}
    assert tokencounts.token_counts(df.where("false"), vocabulary, limit=5).count() == 0


def test_token_cache_encodes_a_text_once(spark, monkeypatch):
    vocabulary = str(public_tokenizers.path("byte_bpe_50k.json"))
    path = table_path(spark, "cache")
    draw = random.Random(2)
    texts = [f"text {draw.randint(0, 20)}" for _ in range(300)] + ["hot"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    first = sorted(map(tuple, tokencounts.token_counts(df, vocabulary, 3, cache=path).collect()))
    kept = spark.read.parquet(path)
    assert kept.count() == kept.select("digest").distinct().count() == len(set(texts))
    assert [r[2] for r in first] == plain_counts(texts, vocabulary)
    again = spark.createDataFrame([*enumerate(texts), (999, "new text")], "doc_id long, text string")
    second = sorted(map(tuple, tokencounts.token_counts(again, vocabulary, 3, cache=path).collect()))
    assert second[:-1] == first and spark.read.parquet(path).count() == len(set(texts)) + 1
    # nothing is missing: no text is encoded, and counts come from the cache, whatever it says
    monkeypatch.setattr(tokencounts, "count_missing", lambda *_: pytest.fail("encoded a known text"))
    assert sorted(map(tuple, tokencounts.token_counts(again, vocabulary, 3, cache=path).collect())) == second
    # another version of the tokenizer has counts of its own
    monkeypatch.setattr(tokencounts, "version", lambda _: "another")
    assert tokencounts.read_cache(spark, path, tokencounts.tokenizer_digest(vocabulary)).count() == 0


def sources_by_hand(docs, least, ranks):
    pattern = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
    occ, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((t or "", lang or "", s or "") for _, t, lang, s in docs):
        found = [w.translate(lower) for w in pattern.findall(text)]
        groups.add((lang, source))
        occ[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in [*own, None]:
            c = Counter({t: sum(occ[lang, x][t] for x in own) if s is None else occ[lang, s][t] for t in kept})
            n = sum(c.values())
            share[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in own:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(share[s][t] - share[None][t], t) for t in kept if occ[lang, s][t] and share[s][t] > share[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_source_divergence_is_the_definition(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    draw = random.Random(3)
    words = [f"W{c}" for c in "abcdefghijklmnop"] + ["straße", "STRASSE", "Größe", "漢字", "a", "ab", "abc", "𝒳y", "é", "É"]
    docs = []
    for i in range(240):
        lang = draw.choice(["en", "en", "de", None])
        source = "hot" if draw.random() < 0.4 else draw.choice(["s1", "s2", None])
        docs.append((i, " ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randint(0, 60))) + draw.choice(["", "\n1x2", "#tag_b"]), lang, source))
    docs += [(500, None, "en", "quiet"), (501, "rare words only", "fr", "a"), (502, "", "fr", "b"), (503, docs[0][1], docs[0][2], docs[0][3])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumnRenamed("doc_id", "term")
    for leaves in (200_000, 5):  # tries handed on whole, and time and again
        monkeypatch.setattr(divergence, "LEAVES", leaves)
        got = sorted(map(tuple, divergence.source_divergence(df.repartition(5), 30, 5, 6).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == sources_by_hand(docs, 30, 6)
    assert divergence.source_divergence(df.where("false")).count() == 0


def test_sources_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choices("abcdefgh", k=20)), "en", f"s{i % 8}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, divergence.source_divergence(df, 30, 5, 50).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == sources_by_hand(docs, 30, 50)


def test_tries_are_walked_in_byte_order():
    draw = random.Random(1)
    for size in (0, 1, 5, 500):
        terms = sorted({bytes(draw.choices(b"ab\xc3\xa9\xff", k=draw.randint(0 if size == 5 else 1, 6))) for _ in range(size)})
        root = divergence.radix_trie(terms)
        assert list(divergence.walk(root)) == [(t, k) for k, t in enumerate(terms)]
        todo, edges = [root], 0
        while todo:
            node = todo.pop()
            assert len(node[0]) != 1 or node[1] is not None or node is root  # no node that could be left out
            assert all(label[0] == first for first, (label, _) in node[0].items())
            edges += len(node[0])
            todo += [below for _, below in node[0].values()]
        assert edges < 2 * max(len(terms), 1)


def test_shares_are_exact_at_any_count():
    counts, sizes = np.array([[0, 7], [10**12, 3]]), np.array([10**13, 40])
    assert divergence.shares(counts, sizes, 5).tolist() == [[1 + 10**9 * (int(c) + 5) // int(s) for c, s in zip(row, sizes, strict=True)] for row in counts]
