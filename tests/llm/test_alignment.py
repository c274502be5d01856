"""op11 against a plain merge of the tokenizers' own results, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tamarisk.llm import token_alignment as ta

JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain_tools():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def merged(text, tools):
    """(A's ids, B's ids, groups, links) of a text by two pointers; None if the bytes differ."""
    t, sp = tools
    if not text:
        return None
    alphabet = ta.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    groups, links, own, i, j, end_a, end_b = [], [], ([], []), 0, 0, len(a[0][1]), len(b[0][1])
    while True:
        links.append((a[i][0], b[j][0]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            own[0].append(a[i][0])
            i += 1
        if step_b:
            own[1].append(b[j][0])
            j += 1
        if step_a and step_b:
            groups.append(own)
            own = ([], [])
            if i == len(a):
                return [x for x, _ in a], [x for x, _ in b], groups, links
            end_a, end_b = end_a + len(a[i][1]), end_b + len(b[j][1])
        elif step_a:
            end_a += len(a[i][1])
        else:
            end_b += len(b[j][1])


def want(texts, tools):
    found = [merged(t, tools) for t in texts]
    count = Counter(link for f in found if f for link in f[3])
    best_a, best_b = Counter(), Counter()
    for (a, b), c in count.items():
        best_a[a], best_b[b] = max(best_a[a], c), max(best_b[b], c)
    out = []
    for f in found:
        if f is None:
            out.append((0,) * 7 + ("",))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == best_b[x[1]] for x in links), sum(count[x] == best_a[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts():
    r = random.Random(4)
    words = ("the", "Übermut", "l'été", "naïve", "antidisestablishmentarianism", "日本語", "x=1;", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't", "12345", "🙂", "é", "ﬁn", "a b", "　", "end.\n", "\tTab")
    some = [r.choice((" ", " ", " ", "  ")).join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    return [*some, some[0], some[0], None, "", " ", "  ", "\n", "a ", " a", "▁", "with ▁ inside", "x\x00y", "word " * 20_000 + "end", "q" * 3_000, "one", "​", "\r\n two"]


def check(spark, tools, given):
    docs = spark.createDataFrame([(i, t, 5, "p", None) for i, t in enumerate(given)], "doc_id long, text string, row int, pair string, count long").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in ta.token_alignment(docs, JSON, MODEL).collect()}
    for i, w in enumerate(want(given, tools)):
        assert got[i] == w, (i, given[i] and given[i][:80])


def test_against_two_pointers(spark, plain_tools):
    check(spark, plain_tools, texts())


def test_in_small_slices_and_shuffled_joins(spark, plain_tools, monkeypatch):
    monkeypatch.setattr(ta, "BROADCAST_PAIRS", 20)
    check(spark, plain_tools, texts()[:50])


def test_encoders_give_what_the_libraries_give(plain_tools):
    t, sp = plain_tools
    a, b = ta.encoders(JSON, MODEL)
    given = [x for x in texts() if x]
    spaced = pa.array([" " + x for x in given], pa.large_string())
    for k in (1, 7, len(given)):
        at = 0
        for x in range(0, len(given), k):
            for own_a, own_b in zip(a.encode(spaced.slice(x, k)), b.encode(spaced.slice(x, k)), strict=True):
                assert own_a.tolist() == t.encode(" " + given[at], add_special_tokens=False).ids
                assert own_b.tolist() == sp.encode(given[at])
                at += 1


def test_edges(spark):
    docs = spark.createDataFrame([(None, "no id"), (3, "twice"), (3, "twice"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_a > 0, r.count_sum) for r in ta.token_alignment(docs, JSON, MODEL).collect()))
    assert [g[:2] for g in got] == [(-1, True), (3, True), (3, True), (4, False)] and got[1] == got[2] and got[3][2] == 0
    assert ta.token_alignment(docs.limit(0), JSON, MODEL).count() == 0
    assert ta.token_alignment(docs.where("doc_id = 4"), JSON, MODEL).count() == 1
