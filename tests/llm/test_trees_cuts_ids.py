"""Merkle manifest, fill-in-middle and byte-level BPE against plain Python and the tokenizers library, on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import bpe, fim, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def odd_rows():
    rng = random.Random(3)
    words = ["Ünder", "日本", "don't", "x1", "  two", "\n", "<P>", "😀", "a", "\t\tb", "<|endoftext|>", "ſ", "\U00033480", "12345", "!?'s"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " ", "\n\n ", "a", "<M>", "<|endoftext|>", "word " * 40000, "y" * 70000, "  ", "a b", " lead", "trail "]
    rows = [(i, t, [None, "en", "", "de", "é"][min(i % 7, 4)], f"s{i % 3}" if i % 5 else None, len(t or "") if i % 4 else None) for i, t in enumerate(texts)]
    return [*rows, (1000, "alone", "zz", "s", 5), (-5, "negative", "en", "s", 8)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("g", "idx", "n", "digest", "siblings", "top", "root", "leaf", "form", "h1", "ids", "decoded", "output", "_row", "_part", "_carry")}
    return spark.createDataFrame(odd_rows(), DOCS).withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def as_table(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("table")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_over(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way(levels, i):
    found = []
    for level in levels[:-1]:
        if (i ^ 1) < len(level):
            found.append((i % 2, level[i ^ 1]))
        else:
            found.append((0, ""))
        i //= 2
    return found


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    values = (doc_id, source, lang, None if n is None else n + more, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest_of(rows):
    """doc_id -> (leaf, subroot, root, proof digest, folded root)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_over([leaf_of(r) for r in sorted((r for r in rows if r[2] == x), key=lambda r: r[0])]) for x in langs}
    over = levels_over([trees[x][-1][0] for x in langs])
    out = {}
    for k, x in enumerate(langs):
        for i, r in enumerate(sorted((r for r in rows if r[2] == x), key=lambda r: r[0])):
            path = way(trees[x], i) + way(over, k)
            h = leaf_of(r, 1 if zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for left, sibling in path:
                h = digest(sibling, h) if left else digest(h, sibling)
            out[r[0]] = (leaf_of(r), trees[x][-1][0], over[-1][0], digest(*(s for _, s in path)), h)
    return out


def test_manifest_query(spark, as_table):
    got = {r["doc_id"]: r for r in queries.op11_merkle(spark, as_table).collect()}
    want = manifest_of(odd_rows())
    assert len(got) == len(want) == len(odd_rows())
    for i, (leaf, subroot, root, proof, folded) in want.items():
        r = got[i]
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) == (leaf, subroot, root, proof, folded)
        assert r["verified"] == (folded == root)
    assert 0 < sum(not r["verified"] for r in got.values()) < len(got)


@pytest.mark.parametrize("bits", [1, 2])
def test_block_roots_are_appends(spark, docs, bits):
    """Small blocks, so that a group takes several passes; the result is that of one block."""
    one = {r["doc_id"]: r for r in merkle.manifest(docs).collect()}
    many = {r["doc_id"]: r for r in merkle.manifest(docs, bits=bits).collect()}
    assert one == many and len({r["root"] for r in many.values()}) == 1
    for r in many.values():
        sub, rest = merkle.fold(r["leaf"], r["idx"], r["n"], r["siblings"])
        assert sub == r["subroot"] and merkle.fold(sub, r["group_idx"], r["groups"], rest) == (r["root"], b"")


def test_repeated_rows_are_leaves(spark, docs):
    rows = odd_rows()[:3] * 40 + [(None, "x", "en", None, None), (None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS)
    got = merkle.folded(merkle.manifest(table), "leaf").collect()
    again = merkle.folded(merkle.manifest(table.repartition(7)), "leaf").collect()
    assert len(got) == len(rows) and all(r["folded_root"] == r["root"] for r in got)
    assert {r["root"] for r in got} == {r["root"] for r in again}
    assert sorted((r["doc_id"] or -1, r["idx"]) for r in got) == sorted((r["doc_id"] or -1, r["idx"]) for r in again)
    assert merkle.folded(merkle.manifest(docs.where("false")), "leaf").collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 3))
def test_open_trees(n, above):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    tree = merkle.OpenTrees(12, n)
    for i, x in enumerate(leaves):
        tree.append(x)
        assert [h for h, _, _ in tree.open] == [b for b in range(12, -1, -1) if (i + 1) >> b & 1], "one open subtree for each bit of the size"
    top = tree.close(merkle.height_of(n) + above)
    want = levels_over([x.hex() for x in leaves])[-1][0]
    for _ in range(above):
        want = digest(want)
    assert top.hex() == want
    if not above:
        for i, w in enumerate(tree.witnesses()):
            assert merkle.fold(leaves[i], i, n, w) == (top, b"")


# Fill-in-middle


def cut(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:x]), "".join(tokens[x:y]), "".join(tokens[y:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_query(spark, as_table, docs):
    got = {r["doc_id"]: r for r in queries.op12_fim(spark, as_table).collect()}
    assert len(got) == len(odd_rows())
    forms = set()
    for i, t, *_ in odd_rows():
        n, form, p, m, out = cut(i, t)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == digest(out) and r["restored_sha256"] == digest(t or "")
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}
    assert fim.transform(docs.where("false")).collect() == []
    assert fim.transform(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(odd_rows())


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fim_restores_whatever_the_unit(docs, unit):
    rows = fim.transform(docs, rate=100, spm_rate=50, seed=7, unit=unit).join(docs.select("doc_id", "text"), "doc_id")
    got = rows.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert all(r["n"] == len(r["text"] or "") for r in got if unit == "char")
    assert all(r["n"] == len((r["text"] or "").replace("\n", "\n|").rstrip("|").split("|")) for r in got if unit == "line" and r["text"] and "|" not in r["text"])


@pytest.mark.parametrize("kind, offsets", [
    ("Values", np.arange(5, 60000, 77)), ("Bitmap", np.arange(1, 65536, 3)), ("Runs", np.concatenate([np.arange(10, 5000), np.arange(6000, 65536)])),
])
def test_containers(kind, offsets):
    found = fim.BoundarySet(offsets)
    assert [type(c).__name__ for c in found.containers] == [kind]
    assert [found.select(k) for k in range(0, len(offsets), 17)] == offsets[::17].tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400_000), min_size=1, max_size=200, unique=True), st.integers(0, 300_000), st.integers(1, 80_000))
def test_select(some, begin, length):
    offsets = np.union1d(np.array(some), np.arange(begin, begin + length))
    found = fim.BoundarySet(offsets)
    for k in {0, len(offsets) // 3, len(offsets) // 2, len(offsets) - 1}:
        assert found.select(k) == offsets[k]


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    return bpe.Vocabulary(VOCABULARY)


def ids_of(coder, texts):
    raw = [t.encode() for t in texts]
    flat, n = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(n)])
    return [flat[a:b].tolist() for a, b in zip(to[:-1], to[1:])]


def test_bpe_query(spark, as_table, docs, library):
    got = {r["doc_id"]: r for r in queries.op13_bpe(spark, as_table).collect()}
    plain = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()}
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert plain[i]["ids"] == ids and plain[i]["decoded"] == library.decode(ids, skip_special_tokens=False) == (t or "")
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), digest(t or ""))
    assert bpe.decode(bpe.encode(docs.where("false"), VOCABULARY, packed=True), VOCABULARY).collect() == []


def test_bpe_equals_the_library(coder, library):
    rng = random.Random(5)
    tokens = [b.decode("utf-8", "ignore") for b in coder.bytes]
    letters = [*map(chr, [*range(32, 127), *range(0xA0, 0x180), 0x20AC, 0x4E2D, 0x558, 0x58B, 0x1F600, 0x85, 0x2003, 9, 10, 13, 0x1C])]
    texts = [*tokens, "x" * 5000, " " * 3000, "ab" * 4000, "\U00033480abc \U00033480", "don't's'll 's ''s !'s"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for pool in (letters, "abcd' ", tokens, tokens) for _ in range(2500)]
    assert ids_of(coder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memo_forgets_and_stays_right(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 50)
    monkeypatch.setattr(bpe, "MEMO_LONG", 100)
    coder.clear()
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(30)), "q" * 300 + str(rng.random()), "<|endoftext|> a"]
        assert ids_of(coder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(coder.number) <= 200
    coder.clear()


def test_long_words_take_linear_work(coder, monkeypatch):
    """Tries of tokens grow with the word, not with its square."""
    tries = []
    monkeypatch.setattr(coder, "apart", lambda a, b, f=coder.apart: tries.append(1) or f(a, b))
    counts = []
    for n in (2000, 4000, 8000):
        rng = random.Random(7)
        tries.clear()
        coder.word("".join(rng.choice("abcdeht") for _ in range(n)))
        counts.append(len(tries) / n)
    assert max(counts) < 1.3 * min(counts)


def test_decode_of_any_ids(spark, library):
    rng = random.Random(8)
    lists = [[rng.randrange(50300) for _ in range(rng.randint(0, 20))] for _ in range(200)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(-1, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(rows, VOCABULARY).collect()}
    assert got.pop(-1) is None
    assert all(got[k] == library.decode(x, skip_special_tokens=False) for k, x in enumerate(lists))


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
