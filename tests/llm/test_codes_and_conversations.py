"""Vector codes, byte-level encoding and conversation repair against brute force, the public library and odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rareflow.llm import bpe, byte_bpe, conversations, vector_codes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = list("ab'strevlmd 01  \n\t 　.,!é中'\x1c\x85\U0001f600")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------ byte-level encoding


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.read_ranks(RANKS), byte_bpe.point_classes())


def ids_of(library, text):
    return np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()


def test_slices_and_merges_are_the_library_s(library, coder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(4000)] + [None, "", "'s", " 's''re"]
    texts += [f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}." for c in (*range(0x3000), *range(0x10000, 0x10400))]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == ids_of(library, text), repr(text)


def test_long_texts_and_long_words(library, coder, monkeypatch):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefgh") for _ in range(6000))
    texts = ["".join(rng.choice(ODD) for _ in range(4000)), "x" * 3000, word, " " * 500 + "a", "a " * 2000]
    want = [ids_of(library, t) for t in texts]
    assert list(coder.encode(texts)) == want
    monkeypatch.setattr(byte_bpe, "CHUNK", 64)
    assert list(coder.encode(texts)) == want
    assert ["".join(byte_bpe.parts(t)) for t in texts] == texts


def test_scan_composes_what_single_steps_do(coder):
    rng = random.Random(3)
    kinds = [rng.randrange(byte_bpe.END + 1) for _ in range(700)]
    state, want = byte_bpe.FRESH, []
    for kind in kinds:
        state, _ = byte_bpe._step(state, kind)
        want.append(state)
    scanner = coder.scanner
    got = scanner.from_fresh[scanner.composition(scanner.of_class[np.array(kinds)])]
    assert got.tolist() == want


def test_byte_encoding_of_odd_rows(spark, library):
    texts = ["It's  two\n\nlines ", None, "", "é" * 9000, "It's  two\n\nlines ", "'ll 42"]
    ids = [1, 2, None, 4, 1, 5]
    rows = [(i, t, "v", 1, b"x") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, v0 int, ids binary")
    want = []
    for i, t in zip(ids, texts, strict=True):
        own = ids_of(library, t)
        raw = (t or "").encode()
        want.append((i, len(own) // 4, hashlib.sha256(own).hexdigest(), hashlib.sha256(raw).hexdigest()))
    got = byte_bpe.round_trip(df, RANKS)
    assert rows_of(got, *got.columns) == sorted(want, key=repr)
    encoded = byte_bpe.encode(df, RANKS)
    back = byte_bpe.decode(encoded, RANKS)
    assert rows_of(back.select("doc_id", F.col("decoded").cast("string"))) == [] or sorted(
        (bytes(r.decoded) for r in back.collect())
    ) == sorted((t or "").encode() for t in texts)
    cut = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS, begin=3, end=11).collect()}
    assert cut[4] == ("é" * 9000).encode()[3:11] and cut[5] == b"'ll 42"[3:11] and cut[2] == b""
    assert byte_bpe.round_trip(df.limit(0), RANKS).count() == 0


def test_long_words_of_the_word_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (4096, 4097, 200_000)] + ["a" * 9000]
    library = Tokenizer.from_file(path)
    got = list(bpe.Encoder(bpe.Merges(path)).encode(texts))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ vector codes


def codes_by_force(rows, entries, parts, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(256 * v) for v in e] for _, e, _ in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].copy()

    def assigned():
        far = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return far.argmin(axis=1), far.min(axis=1).sum(axis=1)

    for _ in range(rounds):
        at, _ = assigned()
        for p in range(parts):
            for k in range(len(books)):
                own = x[at[:, p] == k, p]
                if len(own):
                    books[k, p] = [int(s) // len(own) for s in own.sum(axis=0)]
    at, error = assigned()
    numbers = books.transpose(1, 0, 2).reshape(-1).tolist()
    sha = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    by = {}
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(
        ((i, "".join(f"{c:02x}" for c in at[n]), int(error[n]), by[label], sha) for n, (i, _, label) in enumerate(rows)), key=repr
    )


@pytest.mark.parametrize(("entries", "parts", "rounds"), [(64, 16, 2), (5, 4, 6), (200, 8, 1)])
def test_codes_by_brute_force(spark, entries, parts, rounds):
    rng = np.random.default_rng(entries)
    # Coarse values, so that distances tie; groups of equal vectors; nulls among labels.
    vectors = np.round(rng.normal(size=(150, 32)) * 3) / 4
    vectors[40:70] = vectors[3]
    rows = [(i if i % 50 else None, v.tolist(), None if i % 4 == 0 else i % 3) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "vec_id long, embedding array<double>, label int, id int, parts string")
    got = vector_codes.codes(df.repartition(3), entries=entries, parts=parts, rounds=rounds)
    assert rows_of(got, *got.columns) == codes_by_force(rows, entries, parts, rounds)


def test_rings_hold_every_nearer_entry():
    rng = np.random.default_rng(9)
    for size in (1, 2, 7, 64):
        points, entries = rng.integers(-50, 50, (400, 3)), rng.integers(-40, 40, (size, 3))
        old = vector_codes.assign_all(points, entries)
        moved = entries + rng.integers(-9, 9, entries.shape)
        radii = []
        for e in range(size):
            far = ((points[old == e] - entries[e]) ** 2).sum(axis=1)
            shift = int(((moved[e] - entries[e]) ** 2).sum())
            radii.append(vector_codes.ceil_root(int(far.max())) + vector_codes.ceil_root(shift) if len(far) else -1)
        balls = vector_codes.Balls.of(moved, radii)
        assert np.array_equal(vector_codes.assign_rings(points, old, balls), vector_codes.assign_all(points, moved))


def test_codes_of_odd_vectors(spark):
    rows = [(1, [0.5, None], 1), (2, None, 1), (3, [math.nan, 1.0], 1), (4, [math.inf, 1.0], None), (5, [], 1)]
    rows += [(6, [1e30, -1e30], None), (None, [1.0, 2.0], 3), (7, [1.0, 2.0, 3.0], 3), (6, [1e30, -1e30], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.codes(df).collect()
    assert sorted((r.vec_id or 0, r.code[:6], r.error, r.label_error) for r in got) == [(0, "020200", 0, 0), (6, "000000", 0, 0), (6, "000000", 0, 0)]
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(df.filter("vec_id < 6")).count() == 0


# ------------------------------------------------------------------ conversations

SPACE = " \t\n\x0b\x0c\r"


def repaired_by_force(rows):
    """Fewest costs and then the least audit over all edits, row by row from every state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    told = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = told(role), told(text)
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("b" if not bare.strip(SPACE) else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))

        def inserted(best):
            for _ in range(4):
                for state, (cost, audit, lines) in list(best.items()):
                    for role in ("user", "assistant"):
                        offer(best, step.get((state, role[0])), (cost + 5, audit + "I", (*lines, f"{role}:")))
            return best

        def offer(best, state, made):
            if state is not None and (state not in best or made[:2] < best[state][:2]):
                best[state] = made

        best = inserted({0: (0, "", ())})
        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for state, (cost, audit, lines) in best.items():
                offer(after, state, (cost + 2, audit + "D", lines))
                if fault in ("b", "d"):
                    continue
                cost += 5 * (fault == "t")
                offer(after, step.get((state, role[:1])), (cost, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(after, step.get((state, new[0])), (cost + 1, audit + "R", (*lines, f"{new}:{text}")))
            best = inserted(after)
        cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def conversation_rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = []
    for conv in [None, *range(50)]:
        for i in range(rng.choice([1, 2, 3, 5, 8, 40])):
            text = rng.choice(["Hi.", "Ho", "  ", "", None, "x y!", f"q{i}.", f"r{i}"])
            rows.append((conv, rng.choice([None, i, i, i, i + 1]), rng.choice(roles), text))
    # One long conversation, one of many equal rows, one very long text.
    rows += [(1000, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", f"z {i}.", f"w {i}"])) for i in range(1500)]
    rows += [(1001, 5, "user", "same.")] * 800 + [(1002, 1, "user", "long " * 50_000 + "."), (1002, 2, "assistant", "ok.")]
    return rows


@pytest.mark.parametrize("piece_rows", [256, 7])
def test_repair_by_brute_force(spark, monkeypatch, piece_rows):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    rows = conversation_rows()
    names = "conv_id long, turn long, role string, text string, n int, conv string, part int, seq int, cost int"
    df = spark.createDataFrame([(*r, 1, "c", 2, 3, 4) for r in rows], names).repartition(5)
    got = conversations.report(conversations.repair(conversations.damage(df)))
    assert got.columns == ["conv_id", *conversations.REPORT, "audit", "repaired_sha256"]
    assert rows_of(got, *got.columns) == repaired_by_force(rows)
    assert conversations.report(conversations.repair(conversations.damage(df.limit(0)))).count() == 0


def test_edits_give_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "Me again.", 1), (1, 2, "assistant", "Yes.", 2), (1, 3, "user", "cut", 1)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, n long")
    edits = [e for r in sorted(conversations.repair(df).collect(), key=lambda r: (r.part, r.seq)) for e in r.edits]
    assert "".join(e.edit for e in edits) == "DKKDD"
    assert [(e.role, e.text) for e in edits if e.edit != "D"] == [("user", "Me again."), ("assistant", "Yes.")]


def test_agenda_pops_the_least_audit():
    assert conversations.lightest("ua", 0, conversations.ENDS) == (0, "KK")
    assert conversations.lightest("", 0, conversations.ENDS) == (0, "")
    assert conversations.lightest("xx", 0, conversations.ENDS) == (4, "DD")
    assert conversations.lightest("u", 0, conversations.ENDS) == (2, "D")
    assert conversations.lightest("uu", 0, conversations.ENDS) == (1, "KR")
    assert conversations.lightest("u", 0, (conversations.SYSTEM,)) is None
