"""Manifest, tokenizer alignment and language against brute force."""

import collections
import hashlib
import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runledger.llm import alignment, language, merkle
from runledger.llm.labelled import fold

FOLDER = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [
    (1, "same text here", "en", "src0", 14),
    (2, "same text here", "en", "src0", 14),
    (2, "same text here", "en", "src0", 14),
    (2, "another text of one id", "en", "src0", None),
    (3, None, None, None, None),
    (4, "", "de", "src1", 0),
    (5, " \t\n", "de", "src1", 3),
    (None, "no id at all in this row", "fr", None, 24),
    (None, "no id at all in this row", "fr", None, 24),
    (6, LONG, "en", "src2", None),
    (7, "a ▁ b", "zu", "src3", 5),
    (8, "ﬁ x<|endoftext|> y <s>hi</s> <0x0A> 日本 é 😀 \x00\x1c z", "ja", "src3", 9),
    (9, "  's a\n  b \n c\t d   e  ", "ja", "src3", 9),
    (10, "123 456 ² Ⅷ !", "", "src3", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["g", "o", "h", "row", "block", "pos", "n", "path", "part", "first", "salt", "subroot", "root", "proof", "k", "t", "l", "rid", "pair", "same", "lang_pred", "score", "share", "vector"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: Merkle manifest


def brute_tree(leaves):
    """(root, for each leaf its (left, right) level by level)."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for proof, k in zip(proofs, range(len(at))):
            i = at[k]
            run = i // 8 * 8
            proof.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
            at[k] = i // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], proofs


def brute_manifest(rows):
    """Sorted (leaf, subroot, root, proof) of (group, order, leaf)."""
    groups = collections.defaultdict(list)
    for g, o, h in rows:
        groups[g].append(((o is not None, o), h))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([h for _, h in sorted(groups[g])]) for g in names]
    root, tops = brute_tree([t[0] for t in trees])
    leaves = [[h for _, h in sorted(groups[g])] for g in names]
    return sorted((h, sub, root, proof + top) for (sub, proofs), top, hs in zip(trees, tops, leaves) for h, proof in zip(hs, proofs))


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proved(frame, block):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = frame.withColumn("leaf", merkle.leaf_digest([F.col(c) for c in columns])).drop("text")
    found = merkle.manifest(leaves, "leaf", "lang", "doc_id", block)
    folded = found.withColumn("folded", merkle.fold_proof(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.proof_digest(F.col("proof")))
    expected = brute_manifest([(r.lang, r.doc_id, leaf_of([r[c] for c in columns])) for r in frame.select(columns).collect()])
    return folded, expected


@pytest.mark.parametrize("block", [1, 8, 4096])
def test_manifest_of_odd_rows(docs, block):
    found, expected = proved(docs, block)
    rows = found.collect()
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in rows) == expected
    assert all(r.folded == r.root and r.digest == sha("".join(a + b for a, b in r.proof)) for r in rows)
    assert {r.k for r in rows} == {1}


@pytest.mark.parametrize("block", [1, 8, 64])
def test_manifest_over_many_blocks(documents, block):
    found, expected = proved(documents, block)
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found.collect()) == expected


def test_manifest_of_many_groups_and_of_one_row(spark):
    rows = [(f"l{i % 70}", i, sha(str(i))) for i in range(300)]
    for some in (rows, rows[:1]):
        found = merkle.manifest(spark.createDataFrame(some, "lang string, doc_id long, leaf string"), "leaf", "lang", "doc_id", 8)
        assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in found.collect()) == brute_manifest(some)


def test_manifest_of_nothing(empty):
    assert merkle.manifest(empty.withColumn("leaf", F.lit("")), "leaf", "lang", "doc_id").count() == 0


def test_repeated_rows_lie_in_many_tasks(spark):
    one = spark.range(0, 100_000, 1, 8).select(F.lit("en").alias("lang"), F.lit(None).cast("long").alias("doc_id"), F.lit(sha("x")).alias("leaf"))
    nodes = one.select(F.lit("=en").alias("g"), F.struct("doc_id").alias("o"), F.col("leaf").alias("h"), F.struct("lang").alias("row"))
    placed = merkle._numbered(nodes, 4096)
    assert placed.select("pos").distinct().count() == 100_000 and placed.agg(F.max("pos")).first()[0] == 99_999
    rows = merkle.manifest(one, "leaf", "lang", "doc_id").withColumn("folded", merkle.fold_proof(F.col("leaf"), F.col("proof")))
    assert rows.where("folded = root").count() == 100_000
    assert rows.select("root").distinct().collect()[0][0] == brute_tree([sha("x")] * 100_000)[0]


# 12: alignment of two tokenizers


def brute_alignment(rows):
    """(per row: numbers, digest), links by pair, from the libraries' own results on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    shown = alignment.visible_bytes()
    names = {i: t for t, i in first.get_vocab().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found, links = [], collections.Counter()
    for _, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        bytes_a, bytes_b = [bytes(shown[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not (b"".join(bytes_a) == b"".join(bytes_b) == (" " + (text or "")).encode()):
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = list(itertools.accumulate(map(len, bytes_a))), list(itertools.accumulate(map(len, bytes_b)))
        common = sorted(set(ends_a) & set(ends_b))
        groups = []
        for start, end in zip([0, *common], common):
            groups.append([[i for i, e in zip(ids, ends) if start < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))])
        mine = [(i, j) for i, e in zip(a, ends_a) for j, f in zip(b, ends_b) if e == f] if len(a) < 2000 else [(x[-1], y[-1]) for x, y in groups]
        links.update(mine)
        found.append((len(a), len(b), len(groups), mine, sha(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)) if a else ""))
    most = collections.Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    numbers = [(d, na, nb, ng, len(ls), sum(links[x] == most[x[1]] for x in ls), sum(links[x] for x in ls), h) for (d, _), (na, nb, ng, ls, h) in zip(rows, found)]
    return numbers, {(a, b, n, n == most[b]) for (a, b), n in links.items()}


@pytest.mark.parametrize("head", [0, 5, 1 << 17])
def test_alignment_is_that_of_whole_texts(spark, docs, documents, head):
    frame = docs.where("doc_id is null or doc_id <> 6").select("doc_id", "text").unionAll(documents.where(F.length("text") < 1500).select("doc_id", "text"))
    numbers, pairs = brute_alignment([tuple(r) for r in frame.collect()])
    found = alignment.align(frame, BYTES, PIECES, head=head)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.documents.select(columns).collect()), key=repr) == sorted(numbers, key=repr)
    assert {tuple(r) for r in found.pairs.collect()} == pairs


def test_alignment_of_long_texts_and_clashing_columns(docs):
    found = {r.doc_id: r for r in alignment.align(docs.where("doc_id > 2"), BYTES, PIECES, with_groups=True).documents.collect()}
    assert found[6].n_links == found[6].n_groups == found[6].groups.count(";") + 1 > 30_000
    assert found[6].n_a == found[6].groups.count("|") + sum(g.split("|")[0].count(",") for g in found[6].groups.split(";"))
    assert found[7].n_a == found[3].n_b == found[4].n_groups == 0 and found[7].groups_sha256 == found[3].groups_sha256 == ""
    assert found[6].groups_sha256 == sha(found[6].groups)


def test_alignment_of_nothing(empty):
    found = alignment.align(empty, BYTES, PIECES)
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_ranks_encode_as_the_library(documents):
    import json

    described = json.load(open(BYTES))
    shown = alignment.visible_bytes()
    tokens = {bytes(shown[c] for c in t): i for t, i in described["model"]["vocab"].items() if t != "<|endoftext|>"}
    texts = [r.text or "" for r in documents.collect()] + [r[1] or "" for r in DOCS] + ["ab" * 20_000]
    texts += [f"a{c} {c}{c}1{c}!{c} \n{c}b" for c in map(chr, itertools.chain(range(0x3000), range(0xF900, 0x10000), range(0x1F000, 0x1FB00)))]
    assert alignment._by_ranks(described, tokens)(texts) == alignment._by_library(BYTES)(texts)


def test_equal_groups_do_not_meet_in_the_shuffle():
    aligner = alignment.Aligner(BYTES, PIECES)
    found = aligner.groups(["the house of the rising sun", None, "tokenizers xyzzyq"])
    assert found.same[: found.n_groups[0]].all() and found.n_groups[1] == 0
    assert all(aligner.bytes_a[a] == aligner.bytes_b[b] for a, b, s in zip(found.a, found.b, found.same) if s)
    assert all(aligner.same[a] != b for a, b, s in zip(found.a, found.b, found.same) if not s)


# 13: language


def brute_likelihood(word, chance):
    """Every segmentation, one by one."""
    total = 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        total += math.prod(chance.get(word[i:j], 0.0) for i, j in zip(places, places[1:]))
    return total


@pytest.fixture(scope="module")
def small_model():
    pieces = [b"ab", b"abc", b"bc", b"ca", b"cab", b"aa"]
    v = language.Vocabulary(pieces)
    rng = np.random.default_rng(3)
    p = np.vstack([rng.random((len(v), 3)), np.zeros((1, 3))])
    p[:256] *= np.isin(np.arange(256), list(b"abc"))[:, None]
    return language.Model(v, p / p.sum(axis=0), ["x", "y", "z"])


def test_forward_sums_all_segmentations(small_model):
    words = [b"a", b"abcab", b"aaaa", b"cabcabc", b"abcabcabca", b"bbb"]
    chances = [dict(zip(small_model.vocabulary.pieces, small_model.probabilities[:-1, k])) for k in range(3)]
    expected = [[math.log(brute_likelihood(w, c)) for c in chances] for w in words]
    assert np.allclose(small_model.log_likelihoods(words), expected)


def test_long_words_keep_their_likelihood(small_model):
    """A word too long for plain sums, against logarithms all the way."""
    word = b"abcab" * 400
    chance = dict(zip(small_model.vocabulary.pieces, small_model.probabilities[:-1, 1]))
    logs = [0.0]
    for end in range(1, len(word) + 1):
        logs.append(np.logaddexp.reduce([logs[end - k] + math.log(chance[p]) for k in (1, 2, 3) if k <= end and (p := word[end - k : end]) in chance]))
    assert np.allclose(small_model.log_likelihoods([word])[0, 1], logs[-1])


def test_expected_pieces_by_every_segmentation(small_model):
    words, times, own = [b"abcab", b"cabca"], np.array([2.0, 3.0]), np.array([0, 2])
    expected = np.zeros((len(small_model.vocabulary), 3))
    row = {p: i for i, p in enumerate(small_model.vocabulary.pieces)}
    for word, n, k in zip(words, times, own):
        chance = dict(zip(small_model.vocabulary.pieces, small_model.probabilities[:-1, k]))
        whole = brute_likelihood(word, chance)
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[i:j] for i, j in zip(places, places[1:])]
            way = math.prod(chance.get(p, 0.0) for p in parts)
            for p in parts:
                if p in row:
                    expected[row[p], k] += n * way / whole
    assert np.allclose(small_model.expected(words, times, own), expected)


def test_language_of_held_out_documents(spark, documents):
    model = language.train_language_model(documents, PIECES, fold(F.col("k"), 4) != 2)
    assert model.languages == sorted(model.languages)
    rows = language.identify_language(documents, model).where(fold(F.col("doc_id"), 4) == 2).collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    # Learning from the rows not held out alone: other labels of the held-out ones change nothing.
    changed = documents.withColumn("lang", F.when(fold(F.col("doc_id"), 4) == 2, "xx").otherwise(F.col("lang")))
    again = language.train_language_model(changed, PIECES, fold(F.col("k"), 4) != 2)
    assert again.languages == model.languages and np.allclose(again.probabilities, model.probabilities)


def test_language_of_odd_rows(docs, documents):
    model = language.train_language_model(documents, PIECES, F.lit(True))
    found = language.identify_language(docs.withColumn("lang_pred", F.lit("given")), model)
    assert set(found.columns) == set(docs.columns)
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[k].lang_pred for k in (3, 4, 5, 10)] == ["und"] * 4 and [rows[k].score for k in (3, 4, 5, 10)] == [0.0] * 4
    assert rows[1].lang_pred == rows[2].lang_pred and rows[1].k == 1
    assert rows[6].lang_pred in model.languages and rows[8].lang_pred in model.languages
    assert found.count() == len(DOCS)


def test_language_with_nothing_to_learn_from(docs, empty):
    model = language.train_language_model(empty, PIECES, F.lit(True))
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in language.identify_language(docs, model).collect()} == {("und", 0.0)}
    assert language.identify_language(empty, model).count() == 0
    # Nulls, one language only, equal rows.
    alone = language.train_language_model(docs.where("lang = 'fr' or lang is null"), PIECES, F.lit(True))
    assert alone.languages == ["fr"]
    assert {r.score for r in language.identify_language(docs.where("doc_id = 1"), alone).collect()} == {1.0}
