"""Transducer, conversation repair and spelling variants against plain versions and the tokenizers' own library."""

import base64
import hashlib
import itertools
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctree_spark.llm import bpe_transducer, conversation_repair, licenses, near_dedup, secrets, spelling

# ---- transducer


@pytest.fixture(scope="module")
def byte_bpe():
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        vocabulary = bpe_transducer.Vocabulary(f.read())
    return path, vocabulary, library.Tokenizer.from_file(path)


def ids_of(encoder, text):
    return np.frombuffer(b"".join(encoder.parts(text)), np.int32).tolist()


def made_texts(seed, n):
    draw = random.Random(seed)
    bits = ["a", "e", " ", "  ", "\n", "'", "'re", "'s", "1", "é", "漢", "😀", "-", "<|endoftext|>", "<|endof", "the", "_", "\t", " ", "½", ".", "\x1c", "ⅷ", "مر"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [17, 1 << 16])
def test_ids_are_the_librarys(byte_bpe, monkeypatch, chunk):
    _, vocabulary, library = byte_bpe
    monkeypatch.setattr(bpe_transducer, "CHUNK", chunk)
    encoder = bpe_transducer.Encoder(vocabulary)
    for text in made_texts(1, 2000):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, text
    draw = random.Random(2)
    for kind in ("a", "e", "the", "-", " ", "\n", "ab", "1", "guaranteeing", "=-", "é", "漢"):
        for end in ("", ".", " ", "x"):
            text = draw.choice(["x", ""]) + kind * draw.randint(0, 2500) + end
            assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids, (kind, end)


def test_tokens_come_out_before_a_piece_ends(byte_bpe):
    """However bytes are cut, the same tokens; no more than a window is held."""
    _, vocabulary, library = byte_bpe
    draw = random.Random(3)
    piece = "".join(draw.choice("aeiothnrs") for _ in range(20_000))
    stream, out, at = bpe_transducer.Stream(vocabulary), [], 0
    while at < len(piece):
        step = draw.randint(1, 900)
        out += itertools.chain.from_iterable(stream.push(piece[at : at + step].encode()))
        at += step
        assert len(stream.held) <= stream.window
        assert sum(len(vocabulary.bytes_of[i]) for i in out) >= min(at, len(piece)) - stream.window
    assert out + stream.finish() == library.encode(piece, add_special_tokens=False).ids


def test_lookahead_holds():
    """On small merge lists, over all words: tokens that end so far before the end stay, whatever follows."""
    draw = random.Random(4)
    for _ in range(60):
        parts, merges = ["a", "b"], []
        for k in range(6):
            left, right = draw.choice(parts), draw.choice(parts)
            if left + right not in parts:
                merges.append((left, right))
                parts.append(left + right)
        ids = {p: k for k, p in enumerate(parts)}
        enough = max(bpe_transducer.lookahead([(ids[a], ids[b], ids[a + b]) for a, b in merges]), default=0)

        def tokens(text):
            out = list(text)
            for a, b in merges:
                k = 0
                while k + 1 < len(out):
                    if (out[k], out[k + 1]) == (a, b):
                        out[k : k + 2] = [a + b]
                    k += 1
            return out

        for text in map("".join, itertools.product("ab", repeat=9)):
            whole = tokens(text)
            for cut in range(enough, 9):
                end = 0
                for k, t in enumerate(tokens(text[:cut])):
                    end += len(t)
                    if end > cut - enough:
                        break
                    assert whole[k] == t, (merges, text, cut)


def test_texts_are_the_librarys(byte_bpe, monkeypatch):
    _, vocabulary, library = byte_bpe
    monkeypatch.setattr(bpe_transducer, "DECODE_IDS", 3)
    decoder, draw = bpe_transducer.Decoder(vocabulary), random.Random(5)
    for _ in range(2000):
        ids = [draw.randrange(50257) for _ in range(draw.randint(0, 30))]
        assert "".join(decoder.parts(np.array(ids, np.int64))) == library.decode(ids, skip_special_tokens=False)


def test_op12_follows_the_contract(spark, tmp_path, byte_bpe):
    texts = [*made_texts(6, 40), None, "", "word " * 30_000, "x" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe_transducer.op12_bpe_transducer(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = byte_bpe[2].encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(byte_bpe[2].decode(ids, skip_special_tokens=False)))


def test_transducer_small_cases(spark, byte_bpe):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, None), (2, "", 1)], "doc_id long, text string, ids int").withColumn("decoded", F.lit("x"))
    rows = bpe_transducer.decode(bpe_transducer.encode(docs, byte_bpe[0]), byte_bpe[0]).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in rows) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert bpe_transducer.encode(docs.limit(0), byte_bpe[0]).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([None, 64, -1, 10**6],)], "ids array<int>")
    assert [r.decoded for r in bpe_transducer.decode(odd, byte_bpe[0]).collect()] == [None, "", "a"]


# ---- conversations


def plain_repair(rows):
    """Rows of one conversation after damage, in order: what op11 says of it, by search over all states and edits."""
    faults, seen, said = [], set(), ["s" if r[1][:1] == "s" else r[1][:1] for r in rows]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "")}
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def more(layer):  # insertions, until they gain nothing
        todo = list(layer)
        while todo:
            key = todo.pop()
            cost, audit = layer[key]
            for role in "ua":
                if role in follow[key[1]]:
                    to, new = (key[0], role), (cost + 2, audit + "I")
                    if to not in layer or new < layer[to]:
                        layer[to] = new
                        todo.append(to)
        return layer

    layer = more(best)
    for k, (_, role, _text) in enumerate(rows):
        after = {}

        def put(state, way, after=after, k=k):
            if (k + 1, state) not in after or way < after[(k + 1, state)]:
                after[(k + 1, state)] = way

        for (_, state), (cost, audit) in layer.items():
            put(state, (cost + 3, audit + "D"))
            if faults[k] not in ("blank", "duplicate"):
                stays = cost + (faults[k] == "truncated")
                if role[:1] in follow[state] and role[:1]:
                    put(role[:1], (stays, audit + "K"))
                for new in "ua":
                    if new in follow[state]:
                        put(new, (stays + 2, audit + "R"))
        layer = more(after)
    cost, audit = min(w for (_, state), w in layer.items() if state in ("", "a"))
    out, k, state = [], 0, ""
    for edit in audit:
        own = rows[k] if edit != "I" else None
        k += edit != "I"
        if edit == "D":
            continue
        state = own[1][0] if edit == "K" else "a" if state == "u" else "u"
        name = own[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
        out.append(f"{name}:{own[2] if own else ''}")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    count = Counter(faults)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    digest = lambda r: hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))


def test_op11_follows_the_contract(spark, tmp_path):
    draw = random.Random(7)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], ["Yes.", "No", "So!  \n", " ", None, "", "a b. c", "Why? "]
    rows = []
    for conv in range(400):
        turn = draw.randint(0, 5)
        for _ in range(draw.randint(1, 9)):
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, None]) if conv % 7 == 0 else turn, draw.choice(roles), draw.choice([*texts, f"t{draw.randint(0, 5)}."])))
            turn += draw.choice([1, 1, 1, 1, 0, 2])
    rows += [(1000, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = conversation_repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    assert len(got) == len(by_id)
    for r in got:
        assert tuple(r)[1:] == plain_repair(plain_damage(by_id[r.conv_id])), r.conv_id


def test_trie_computes_shared_layers_once():
    trie = conversation_repair.Trie()
    signatures = sorted("".join(p) for p in itertools.product("suUax", repeat=4))
    got = [trie.answer(s) for s in signatures]
    assert trie.computed == 5 + 25 + 125 + 625
    assert got == [conversation_repair.Trie().answer(s) for s in signatures]


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi again."), (2, 7, "user", "One."), (2, 7, "user", "One.")]
    rows = [(c + 50 * k, t, r, x) for k in range(8) for c, t, r, x in rows]
    answered, turns = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"cost": F.lit("x"), "kind": F.lit(1), "place": F.lit(2)}))
    out = defaultdict(list)
    for r in conversation_repair.repaired_turns(turns, answered).orderBy("conv_id", "place").collect():
        assert r.place == len(out[r.conv_id])
        out[r.conv_id].append(r.role[0])
    assert answered.count() == 16 and out
    assert all(re.fullmatch("s?(ua)+", "".join(x)) for x in out.values())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    answered, turns = conversation_repair.repair(none)
    assert answered.count() == conversation_repair.repaired_turns(turns, answered).count() == conversation_repair.repaired_hashes(turns, answered).count() == 0


# ---- spelling


def plain_variants(rows):
    total = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{name}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w in words:
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 5 * words[w] else None, len(near))
    rows = []
    for w, (form, n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, words[w], n, words[form] if form else None))
    return sorted(rows)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_op13_follows_the_contract(spark, tmp_path):
    draw = random.Random(8)
    bases = ["".join(draw.choice("abçéß") for _ in range(draw.randint(5, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaa", "aaaaabaaaa", "z" * 64, "z" * 65, "z" * 66, "y" * 40 + "x" * 60, "y" * 39 + "x" * 60, "y" * 40 + "w" + "x" * 59]
    words = list(bases)
    for w in bases * 8:
        i = draw.randrange(len(w))
        words.append(draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("abçéß÷") + w[i:], w[:i] + draw.choice("abç") + w[i + 1 :]]))
    often = {w: 5 ** draw.randint(1, 4) for w in set(words)}
    flat = [w.upper() if w.isascii() and draw.random() < 0.2 else w for w, n in often.items() for _ in range(n)]
    draw.shuffle(flat)
    rows = [(k, draw.choice([" ", "\n", "漢", "-"]).join(flat[k * 300 : k * 300 + 300])) for k in range(len(flat) // 300 + 1)] + [(10**6, None), (10**6 + 1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, spelling.op13_spelling_variants(spark, str(tmp_path)).collect()))
    want = plain_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 50 and max(r[4] for r in want) > 3


def test_equal_hashes_are_told_apart_by_strings(spark, monkeypatch):
    """With every key the same, the same neighbours."""
    words = ["parrot", "parot", "carrot", "carot", "parrots", "pxrrot", "zebra", "zebras"]
    plain = {w: sum(one_edit(v, w) for v in words if v != w) for w in words}
    number, place, keys, first = spelling.deletion_keys(words)
    rows = [(0, int(p), bool(f), words[k], 10 + int(k)) for k, p, f in zip(number, place, first, strict=True)]
    df = spark.createDataFrame(rows, spelling._KEYS).coalesce(1).mapInArrow(spelling._neighbours, "word string, near long, less long, other string")
    got = {r.word: r.n for r in df.groupBy("word").agg(F.sum("near").alias("n")).collect()}
    assert got == {w: n for w, n in plain.items() if n}
    assert len(set(keys.tolist())) == len({w[:p] + w[p + 1 :] if p >= 0 else w for w, p in ((words[k], p) for k, p in zip(number, place, strict=True))})


def test_spelling_small_cases(spark):
    docs = spark.createDataFrame([(None, "parrot " * 6), (1, None), (2, ""), (2, "Parrot PARROT"), (2, "÷×÷×÷× " * 5)], "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x")})
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == {"parrot": 8, "÷×÷×÷×": 5}
    assert spelling.word_counts(docs.limit(0)).count() == 0
    assert spelling.group_variants(spelling.word_counts(docs.limit(0))).count() == 0
    chain = spark.createDataFrame([("aaaaaa" + "b" * 0, 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), (None, 7)], "word string, n int").withColumn("form", F.lit(1))
    assert {r.word: r.root for r in spelling.group_variants(chain).collect()} == {w: "aabbbb" for w in ("aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb")}


# ---- secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def made_keys():
    draw = random.Random(9)
    number = lambda n: der(2, b"\0" + bytes([128 + draw.randrange(128)]) + draw.randbytes(n - 1))
    rsa = der(0x30, der(2, b"\0"), number(256), der(2, b"\1\0\1"), number(256), *(number(128) for _ in range(5)))
    pkcs8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5)), der(4, rsa))
    short = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, draw.randbytes(32))))
    return rsa, pkcs8, short


def test_keys_in_many_encodings():
    rsa, pkcs8, short = made_keys()
    text = base64.b64encode(pkcs8).decode()
    lines = textwrap.wrap(text, 64)
    pem = ["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"]
    hexes, cipher = pkcs8.hex(), base64.b64encode(random.Random(1).randbytes(1200)).decode()
    encrypted = ["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", "", *textwrap.wrap(cipher, 64), "-----END RSA PRIVATE KEY-----"]
    kinds = {
        "pem": "\n".join(pem), "json": '{"private_key": "' + "\\n".join(pem) + '\\n"}', "quoted": "\n".join(f"> {x}" for x in pem), "comment": "\n".join(f"// {x}" for x in pem), "encrypted": "\r\n".join(encrypted), "encrypted in json": "\\n".join(encrypted),
        "run": text, "url": text.replace("+", "-").replace("/", "_"), "wrapped": "\n".join(lines), "wrapped, quoted": "\r\n".join(f">> {x}" for x in lines), "strings": " +\n".join(f'"{x}"' for x in lines), "escaped": "\\n".join(lines), "behind a path": "keys/" + text,
        "hex": hexes, "wrapped hex": "\n".join(textwrap.wrap(hexes, 64)), "colons": ":".join(textwrap.wrap(hexes, 2)), "colons in lines": ":\n    ".join(":".join(x) for x in itertools.batched(textwrap.wrap(hexes, 2), 15)), "blanks": " ".join(textwrap.wrap(hexes, 2)),
        "behind two digits": "fa" + hexes, "behind one digit": "f" + hexes.upper(), "short": base64.b64encode(short).decode(), "short behind a path": "keys/" + base64.b64encode(short).decode(), "short hex": short.hex(), "old": base64.b64encode(rsa).decode(),
    }
    for name, secret in kinds.items():
        whole = f"some words before\n\n{secret}\n\nand some behind it"
        found = [(a, b) for k, a, b in secrets.find_secrets(whole) if k == "key"]
        assert len(found) == 1, (name, found)
        at = whole.index(secret)
        assert at <= found[0][0] <= at + 20 and at + len(secret) - 4 <= found[0][1] <= at + len(secret), (name, found, at, at + len(secret))
        assert "MII" not in secrets.redacted(whole) and hexes[200:240] not in secrets.redacted(whole)
        both = [k for k, _, _ in secrets.find_secrets(f"{whole}\n{whole}") if k == "key"]
        assert len(both) == 2, name


def test_what_only_looks_like_a_key_is_none():
    rsa, _, _ = made_keys()
    broken = bytearray(rsa)
    broken[3] ^= 1
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(3, b"\0" + rsa[:200]))
    for data in (bytes(broken), public, rsa[:-1], random.Random(2).randbytes(900)):
        text = base64.b64encode(data).decode().rstrip("=")
        for secret in (text, "\n".join(textwrap.wrap(text, 64)), data.hex(), ":".join(textwrap.wrap(data.hex(), 2)), "-----BEGIN X-----\n" + text + "\n-----END X-----"):
            assert not [k for k, _, _ in secrets.find_secrets(secret) if k == "key"], secret[:60]


def test_time_follows_length():
    for unit in ("A" * 63 + "\n", "30", "3082", "MIIE", "ab:", "-----BEGIN A-----\n", "x" * 30 + "\\n", "M" * 23 + " ", "0 " * 10):
        took = []
        for n in (100_000, 400_000):
            text = unit * (n // len(unit))
            began = time.process_time()
            secrets.find_secrets(text)
            took.append(time.process_time() - began)
        assert took[1] < 0.5 + 10 * took[0], (unit, took)


# ---- licenses


@pytest.mark.parametrize("said, license", [
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("This project is licensed under the MIT License.", "MIT"), ("Licensed under the terms of the MIT license.", "MIT"), ("Distributed under Apache License 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("Our code is available under the Mozilla Public License 2.0, as ever", "MPL-2.0"), ("licensed under the GNU General Public License v2.0 only", "GPL-2.0"), ("it is licensed under GPL v3!", "GPL-3.0"),
])
def test_short_notices(said, license):
    for text in (said, f"some words here\n{said}\nand there", f"{'word ' * 60}{said}{' word' * 60}"):
        found = {f["license"] for f in licenses.Scanner(licenses.TEMPLATES, licenses.NOTICES).scan(text) if f["confirmed"]}
        assert found and all(x.startswith(license) for x in found), (text, found)


def test_other_versions_and_words_are_no_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.NOTICES)
    for said in ("SPDX-License-Identifier: Apache-1.1", "licensed under the Apache License, Version 1.1", "not to be licensed, under the MIT terms", "licensed under the Mozilla Public License 1.1", "SPDX-License-Identifier: GPL-3.0-with-exception"):
        assert not [f for f in scanner.scan(said) if f["confirmed"]], said
    for name, said in licenses.NOTICES.items():
        for text in said:
            found = {f["license"] for f in scanner.scan(text) if f["confirmed"]}
            assert found and all(x.startswith(name.removesuffix("-notice")) for x in found), (name, text, found)
    # in a run of cues too long to be looked at as a whole, over a line end, and twice
    run = [f"line {k} of a license list" for k in range(400)]
    run[200:200] = ["it is licensed", "under the terms of the MIT License, and again licensed under the terms", "of the MIT License"]
    text = "\n".join(run)
    found = [text[f["start"] : f["end"]] for f in scanner.scan(text) if f["license"] == "MIT-notice"]
    assert found == ["licensed\nunder the terms of the MIT License", "licensed under the terms\nof the MIT License"]


# ---- near duplicates


def outside_rows(seed, n, shared, own, near=0):
    """Sets with a common part as members of a leader's group, some of them near copies of others."""
    draw = np.random.default_rng(seed)
    common = draw.integers(-(2**62), 2**62, shared)
    sets = [np.unique(np.concatenate([common, draw.integers(-(2**62), 2**62, own)])) for _ in range(n - near)]
    sets += [np.unique(np.concatenate([s[: len(s) - k % 40], draw.integers(-(2**62), 2**62, k % 40)])) for k, s in enumerate(sets[:near])]
    leader = np.unique(np.concatenate([common, draw.integers(-(2**62), 2**62, own)]))
    rows = []
    for k, s in enumerate(sets):
        differ = np.concatenate([np.setdiff1d(s, leader), np.setdiff1d(leader, s)])
        rows.append(([0, 0, 0, 0, k, len(s), len(np.intersect1d(s, leader)), len(leader), k], differ))
    return sets, rows


@pytest.mark.parametrize("shared, own", [(116, 60), (10, 20), (200, 10), (0, 30)])
def test_links_in_a_block_equal_all_pairs(shared, own):
    sets, rows = outside_rows(shared, 120, shared, own, 60)
    block = near_dedup._Outside(rows)
    for k, (row, differ) in enumerate(rows):
        common = [len(np.intersect1d(sets[k], s)) for s in sets]
        want = [j for j, m in enumerate(common) if j != k and 100 * m >= 75 * (len(sets[j]) + len(sets[k]) - m)]
        assert sorted(block.links(row, differ)) == want


def test_boilerplate_isnt_compared():
    """Texts that share two thirds and are no links: comparisons don't grow with the square of the group."""
    for n in (500, 2000):
        _, rows = outside_rows(1, n, 116, 60)
        block = near_dedup._Outside(rows)
        assert not any(block.links(*r) for r in rows)
        assert block.compared <= 4 * n, (n, block.compared)
