"""Token counts, spelling variants and prefix tries: the library, brute force, edge cases."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from tokenizers import Tokenizer

from contrail.llm import prefix_trie, spelling, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, word string, n long, id long, rows long, value long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Other columns clash with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 7, 3, 1, 2) for i, t in rows], DOCS)


# --- token counts ---------------------------------------------------------------------------------------------------------

ODD = [
    None, "", " ", "\n\n", "one", " one", "one ", "It's we'll they'd 's 'S ''ve", "a  b   c\t\td \n\n e", "x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|> <|endoftext|>b", "<|endoftext|",
    "naïve Größe über ß", "日本語 の テキスト。", "한국어 문장", "مرحبا بالعالم", "नमस्ते दुनिया", "emoji 👩‍👩‍👧 🎉🎉", "x  y z　w", "1234 ½ ² ৩ Ⅷ", "\x00\x01\x1c\x1d a\x1eb", "zero​width ⁠x﻿", "a" * 5000, " " * 3000 + "x",
    "!?" * 900, "ԥ ԯ Ա", "𝔘𝔫𝔦 𐍈 \U000323b0x", "ⅷ㊗㍿", "tab\u0085next  x y", "ᠢ᠎ᠢ",
]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_as_the_library_counts(spark, monkeypatch):
    rng = random.Random(1)
    pool = [c for t in ODD[4:] for c in t[:40]] + list(" \n\t'<|>endoftext  ")
    texts = ODD + ["".join(rng.choices(pool, k=rng.randrange(1, 200))) for _ in range(150)] + ["again and again"] * 40
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    want = Counter((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, library(texts)))
    for block in (64, 1 << 22):
        monkeypatch.setattr(token_counts, "BLOCK", block)
        got = token_counts.token_counts(frame(spark, rows).repartition(3), BPE, 100)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert Counter(map(tuple, got.collect())) == want


def test_counts_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op11(spark, SMALL).collect()}
    assert got == dict(zip((r["doc_id"] for r in docs), library([r["text"] for r in docs])))


def test_no_documents_no_counts(spark):
    assert token_counts.token_counts(frame(spark, []), BPE).collect() == []


def test_plain_code_points_are_of_the_librarys_classes():
    own = Tokenizer.from_file(BPE).pre_tokenizer
    pieces = lambda t: [t[a:b] for _, (a, b) in own.pre_tokenize_str(t)]
    for low, high in token_counts.PLAIN:
        for c in map(chr, range(low, high + 1)):
            for text in (f"a{c}", f"1{c}", f"!{c} b", f"a{c}  "):
                assert token_counts.PRE_TOKEN.findall(text) == pieces(text), hex(ord(c))


def test_texts_are_only_cut_where_no_pre_token_is():
    """All code points that aren't plain: behind white space the library goes on as if the text began there."""
    own = Tokenizer.from_file(BPE).pre_tokenizer
    white = re.compile(f"[{token_counts.WHITE}]")
    for c in map(chr, range(0x530, sys.maxunicode + 1, 1)):
        if "\ud800" <= c <= "\udfff" or not token_counts.OTHER.match(c):
            continue
        is_white = own.pre_tokenize_str(f"a{c}  ")[-1][1] != (2, 4)
        assert bool(white.match(c)) == is_white, hex(ord(c))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_a_pre_token_is_counted_once(spark, monkeypatch):
    """Blocks of one text each: the library sees every distinct pre-token once."""
    monkeypatch.setattr(token_counts, "BLOCK", 1)
    texts = [" the same words over and over"] * 30
    docs = frame(spark, enumerate(texts))
    blocks = docs.repartition(2).mapInArrow(token_counts._blocks(BPE), token_counts.BLOCKS)
    assert blocks.count() == 30
    got = token_counts.token_counts(docs, BPE).select("n_tokens").distinct().collect()
    assert [r[0] for r in got] == library(texts[:1])


# --- spelling variants ----------------------------------------------------------------------------------------------------


def variants(rows, shortest=7, least=2, times=10, every=31):
    lower = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {a: [b for b in words if a != b and one_edit(a, b)] for a in words}
    best = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if words[b] >= times * words[a]}

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {(a, form.get(a), root(a), words[a], len(near[a]), words.get(form.get(a))) for a in words}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelled(rng, count):
    """Words of few syllables and letters, so that nearly all have neighbours, with edits at every place."""
    parts = ["ab", "an", "ana", "ing", "tion", "é", "ße", "ra", "x"]
    base = ["".join(rng.choices(parts, k=rng.randrange(3, 7))) for _ in range(count)]
    out = list(base)
    for w in base:
        i, c = rng.randrange(len(w) + 1), rng.choice("anié")
        out += [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]
    return out


@pytest.mark.parametrize("few,every", [(1, 31), (4, 5), (10**6, 2)])
def test_variants(spark, monkeypatch, few, every):
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(few)
    pool = spelled(rng, 120)
    rows = [(i if i % 9 else None, " ".join(rng.choices(pool, weights=[1 + 60 * (k % 11 == 0) for k in range(len(pool))], k=90)).title() + ", ABANAna-1") for i in range(60)]
    rows += [(1, None), (2, ""), (3, "ÀÉÎÕÜÝÞ àéîõüýþ ÀÉÎÕÜÝÞ àéîõüýþ"), (4, "anananananan " * 3 + "ananananananan " * 40), rows[0], rows[0], (5, f"{'q' * 40_000} " * 2 + f"{'q' * 40_001} " * 2)]
    got = spelling.spelling_variants(frame(spark, rows).repartition(4), every=every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants([r for r in rows if not (r[1] or "").startswith("qqq")], every=every)
    have = {tuple(r) for r in got.collect()}
    assert {r for r in have if not r[0].startswith("qqq")} == want
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 5
    if every == 31:  # neither run is one of those that lose a letter
        assert sorted(len(r[0]) for r in have if r[0].startswith("qqq")) == [40_000, 40_001]


def test_forms_are_followed_to_the_root(spark):
    texts = ["abcdefgh " * 2 + "abcdefgi " * 20 + "abcdefii " * 200 + "abcdeiii " * 2000 + "abcdiiii " * 20000]
    got = {r["word"]: r for r in spelling.spelling_variants(frame(spark, enumerate(texts)), every=10**10).collect()}
    assert {r["root"] for r in got.values()} == {"abcdiiii"} and got["abcdefgh"]["form"] == "abcdefgi" and got["abcdiiii"]["form"] is None


def test_ties_go_to_the_smallest_form(spark):
    texts = ["aaaaaaa " * 2 + "aaaaaab " * 20 + "aaaaaaà " * 20 + "aaaaaaÿ " * 20]
    got = {r["word"]: r for r in spelling.spelling_variants(frame(spark, enumerate(texts)), every=10**10).collect()}
    assert (got["aaaaaaa"]["form"], got["aaaaaaa"]["n_near"], got["aaaaaaa"]["form_n"]) == ("aaaaaab", 3, 20)


def test_words_one_edit_apart_share_a_list():
    """For any dictionary: the guarantee, not its luck."""
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randrange(7, 14)))
        i = rng.randrange(len(word))
        other = rng.choice([word[:i] + word[i + 1 :], word[:i] + "d" + word[i:], word[:i] + "b" + word[i + 1 :]])
        if len(other) < 7 or other == word:
            continue
        grams = {w[a : a + q] for w in (f"^{word}$", f"^{other}$") for q in range(3, 7) for a in range(len(w) - q + 1)}
        frequent = {g: rng.randrange(40, 900) for g in sorted(grams) if rng.random() < 0.6}
        have = [spelling.lists_of(w, frequent) for w in (word, other)]
        assert {t for t, _ in have[0]} & {t for t, _ in have[1]}
        places = [dict(h) for h in have]
        assert any(abs(places[0][t] - places[1][t]) <= 1 for t in set(places[0]) & set(places[1]))


@pytest.mark.parametrize("few", [1, 10**6])
def test_words_of_repeated_grams_lose_no_link(spark, monkeypatch, few):
    """Where an edit takes a gram's first occurrence, its other ones get its number at another place."""
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(1)
    pool = []
    for _ in range(150):
        w = (rng.choice(["ab", "an", "a", "aab", "abc", "ß", "ñé"]) * 16)[: rng.randrange(7, 16)]
        j, c = rng.randrange(len(w)), rng.choice("abñ")
        pool += [w, w[:j] + w[j + 1 :], w[:j] + c + w[j:], w[:j] + c + w[j + 1 :]]
    rows = [(i, " ".join(rng.choices(pool, k=60))) for i in range(60)]
    assert {tuple(r) for r in spelling.spelling_variants(frame(spark, rows)).collect()} == variants(rows, every=31)


def test_near_counts_code_points_not_bytes(spark):
    """asmente and asmenteí differ by one code point, which UTF-8 writes as two bytes."""
    got = {r["word"]: r for r in spelling.spelling_variants(frame(spark, [(1, "asmente " * 20 + "asmenteí " * 2 + "ñsmente " * 2)]), every=10**10).collect()}
    assert got["asmente"]["n_near"] == 2 and got["asmenteí"]["form"] == got["ñsmente"]["form"] == "asmente"


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "short words only")])).collect() == []


# --- prefix tries ---------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string, k1 long, depth long, open boolean, base long, h int"


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - c % 20, [])[:h] + v[h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, v in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return Counter((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), children[k], leaves[k], saved[k], digest(k)) for k, v in nodes.items())


def nodes(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, False, 3, 4) for r in rows], TURNS).repartition(3)
    out = prefix_trie.prefix_trie(df, **more)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    out = []
    for c in range(1, 130):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", None, "d  e f"])) for _ in range(rng.randrange(1, 6))]
        out += [(c if c % 17 else c + 10**12, None if i == 0 and c % 5 == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    out += [(c, i, "user", f"the same {i}") for c in range(400, 460) for i in range(5)]  # copies, more than a range holds
    out += [(700, i, "user", "long " * (i % 3)) for i in range(150)] + [(700 + 20, i, "user", "long " * (i % 3)) for i in range(140)]
    return out + [(None, 0, "user", "nobody"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie")]


@pytest.mark.parametrize("per_range", [1, 40, 1 << 19])
def test_trie(spark, conversations, per_range):
    assert nodes(spark, conversations, per_range=per_range) == trie(conversations)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "x")], [(c, None, None, None) for c in range(1, 9)], [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a", "bc")]])
def test_small_tries(spark, rows):
    assert nodes(spark, rows) == (trie(rows) if rows else Counter())


def test_equal_rows_are_turns_of_their_own(spark):
    rows = [(20, 0, "user", "again")] * 3 + [(21, 0, "user", "again")] * 2
    assert nodes(spark, rows) == trie(rows)


def test_range_minima():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, 5, n)
        table = prefix_trie.Minima(values)
        for at in range(n + 1):
            for least in range(6):
                end = at
                while end < n and values[end] >= least:
                    end += 1
                begin = at
                while begin and values[begin - 1] >= least:
                    begin -= 1
                assert table.right(np.array([at]), np.array([least]))[0] == end and table.left(np.array([at]), np.array([least]))[0] == begin
        a, b = np.triu_indices(n)
        assert (table.least(a, b + 1) == [values[x : y + 1].min() for x, y in zip(a, b)]).all()


def test_keys_tell_prefixes_apart():
    a = np.array([1, 2, 1, 2, 2, 1], np.uint64)
    start = np.array([0, 2, 4, 4, 6])
    k1, k2 = prefix_trie.prefix_keys(a, a + np.uint64(9), start)
    pairs = list(zip(k1.tolist(), k2.tolist()))
    assert pairs[:3] == pairs[3:6] and pairs[6] == pairs[0] == pairs[7] and len(set(pairs)) == 5
