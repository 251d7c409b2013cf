"""Each operator against a brute-force version, and on rows that break careless code."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from rareflow.llm import (
    bpe,
    html_text,
    licences,
    line_templates,
    lm_scores,
    mixing,
    neighbours,
    quality_rules,
    simhash,
    warc,
)
from rareflow.llm.components import components
from rareflow.llm.lexicon import Lexicon, compile_lexicon
from rareflow.session import stage_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names operators use inside.
EXTRA = "id long, text_ string, size int, row int, words string, bits long, line string, doc int, html string, _row int"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def texts():
    base = [prose(RNG.randrange(3, 120)) for _ in range(40)]
    near = [b.replace(b.split()[1], "changed", 1) for b in base[:15]]
    odd = ["", " \n\t", "one", "one two", "ÀÉ ÀÉ ÀÉ ÀÉ", "x" * 50_000, prose(20_000), "a b c\n\na b c\n a b c", "Σ ΑΣ don't 12 <|endoftext|> é"]
    return base + near + base[:5] + odd + [None, None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 4}") for i, t in enumerate(texts())]
    rows += [(None, "one two", "en", "src1"), (None, None, None, None), rows[3], rows[3]]
    extra = (1, "x", 2, 3, "w", 4, "l", 5, "h", 6)
    return stage_table(
        spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, {EXTRA}")
    )


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ------------------------------------------------------------------ quality rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_measure_what_brute_force_does(docs):
    got = rows_of(quality_rules.measure(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((r.doc_id, *measured(r.text)) for r in docs.collect()), key=repr)
    assert got == want


def test_many_repeated_windows(spark):
    words = [RNG.choice("abcdefghijk") for _ in range(6000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert quality_rules.measure(df).first().n_repeat_words == measured(" ".join(words))[4]


def test_policies_and_ablations(docs):
    ledger = quality_rules.ledger(docs)
    judged = quality_rules.verdicts(ledger)
    assert judged.filter("base_failed and kept").count() == 0
    assert quality_rules.keep_good(docs).count() == judged.filter("kept").count()
    assert quality_rules.keep_good(docs).columns == docs.columns
    bits = [r.failed for r in ledger.select("failed").collect()]
    for row in quality_rules.ablations(ledger).collect():
        bit = next(1 << r.bit for r in quality_rules.RULES if r.name == row.rule)
        assert row.n_failed == sum(b & bit > 0 for b in bits)
        assert row.n_only_this == sum(b == bit for b in bits)


# ------------------------------------------------------------------ near duplicates


def print_of(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs):
    rows = docs.collect()
    prints = [print_of(r.text) for r in rows]
    distinct = sorted(set(prints))
    root = smallest_reachable(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    first = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        first[root[p]] += [r.doc_id] if r.doc_id is not None else []
    want = sorted(((r.doc_id, f"{p:016x}", min(first[root[p]])) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(v) for v in first.values())


def test_links_of_dense_lists(spark):
    """Many fingerprints around a few centres: every link within two bits is found, no other."""
    rng = np.random.default_rng(1)
    found = set()
    for center in rng.integers(0, 2**63, 4):
        for _ in range(400):
            value = int(center)
            for bit in rng.integers(0, 64 if rng.random() < 0.2 else 12, rng.integers(0, 7)):
                value ^= 1 << int(bit)
            found.add(value)
    found = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "bits long"))).collect()
    bits = np.array(found, dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2, 1))
    root = smallest_reachable(sorted(signed), [(signed[a], signed[b]) for a, b in near])
    alone = {n for n in signed if list(root.values()).count(root[n]) == 1}
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if n not in alone}


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(1000, x) for x in range(1001, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{x: 1000 for x in range(1000, 1100)}}


# ------------------------------------------------------------------ neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 16))
    vectors[50:60] = vectors[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("id") % 20 == 0)
    hits, by = 0, defaultdict(list)
    for r in got.collect():
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    for query in range(0, 600, 20):
        scores = neighbours.exact_scores(vectors[query], vectors)
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != query][:20]
        own = sorted(by[query])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        assert all(s == scores[v] for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(order))
    assert hits / 600 >= 0.9


def test_neighbours_of_few_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [math.nan, 1.0]), (5, [0.0, 0.0]), (20, [None, 1.0])]
    rows += [(40, [2.0, 1.0]), (None, [1.0, 1.0]), (40, [2.0, 1.0]), (60, [1.0]), (7, []), (8, [math.inf, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(neighbours.nearest_neighbours(df, F.col("id") % 20 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 40, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 0.0), (40, 1, 0, 2.0), (40, 2, 1, 2.0), (40, 3, 2, 1.0)]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0


# ------------------------------------------------------------------ archives


def test_archives_round_trip_and_repeat(spark):
    big = "é" * 600
    rows = [(1, "u1", big), (2, None, big), (2, "u", big), (None, "a\nb", big), (3, "%0A", None), (4, "", ""), (2**53 + 1, "z", "x" * 2000), (2**53, "z", "x" * 2000)]
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")
    manifests = []
    for _ in range(2):
        base = warc.archive_folder(spark)
        manifests.append(rows_of(warc.write_archives(df, base, shard_bytes=1500, file_bytes=400), "file", "records", "bytes", "sha1"))
        back = warc.read_archives(spark, base).collect()
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3
    assert sorted((r.page_id or 0, r.url or "") for r in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    by = defaultdict(list)
    for r in back:
        by[r.page_id].append(r)
        body = next((x[2] or "" for x in rows if x[0] == r.page_id), "")
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == hashlib.sha1(body.encode()).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == body.encode()
    assert [r.record_type for r in by[1]] == ["revisit"] and by[1][0].refers_to == 2
    assert sorted(r.record_type for r in by[2]) == ["response", "revisit"]
    assert by[None][0].refers_to == 2 and by[2**53][0].refers_to == 2**53 + 1


def test_no_pages_make_no_archive(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    base = warc.archive_folder(spark)
    assert warc.write_archives(df, base).count() == 0 and warc.read_archives(spark, base).count() == 0


# ------------------------------------------------------------------ line templates


def lines_left(rows):
    """The documented rule, one line after the other."""
    variable = re.compile(rb"[0-9@]|://")

    def words(line):
        own = line.encode().split()
        out = [b"<*>" if variable.search(w) else w for w in own]
        return tuple(own if all(w == b"<*>" for w in out) else out)

    nodes, template = defaultdict(set), {}
    for _, text in rows:
        for line in (text or "").split("\n"):
            w = words(line)
            if w:
                nodes[len(w), w[:3]].add(w)
    for _ in range(line_templates.LEVELS):
        down = defaultdict(set)
        for node, own in nodes.items():
            if len(own) < 2:
                continue
            columns = [Counter(column) for column in zip(*own, strict=True)]
            pattern = [next((w for w, n in c.items() if 2 * n > len(own)), None) for c in columns]
            marks = [len({xxhash.xxh64_intdigest(w) + (1 << 63) & 63 for w in c}) for c in columns]
            open_places = [i for i, c in enumerate(columns) if len(c) > 1]
            split = min(open_places, key=lambda i: (marks[i], i))
            for w in own:
                if sum(a == b for a, b in zip(w, pattern, strict=True)) >= 0.8 * len(w):
                    template[w] = node
                else:
                    down[node, split, w[split]].add(w)
        nodes = down
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if words(line):
                holders[template.get(words(line), words(line))].add((i is None, i or 0))
    out = []
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            own = holders[template.get(words(line), words(line))] if words(line) else None
            if not own or len(own) < 2 or min(own) == (i is None, i or 0):
                kept.append(line)
        out.append((i, None if text is None else "\n".join(kept)))
    return out


def test_recurring_lines(spark):
    lines = [prose(RNG.randrange(4, 9)) for _ in range(60)]
    rows = []
    for i in range(80):
        own = [RNG.choice(lines) for _ in range(4)] + [f"user {RNG.randrange(99)} came in from room {i} today", prose(7), ""]
        changed = RNG.choice(lines).split()
        changed[-1] = "other"
        rows.append((i, "\n".join([*own, " ".join(changed)])))
    rows += [(90, None), (91, ""), (None, "\n".join(lines[:3])), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, at int, template string, drop int")
    got = line_templates.drop_recurring(df)
    assert rows_of(got, "doc_id", "text") == sorted(lines_left(rows), key=repr)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert line_templates.drop_recurring(df.limit(0)).count() == 0


def test_several_templates_in_a_leaf(spark):
    """Three templates with free words under one count and first words: each line but the first of its template goes."""
    ends = ["red gate stays shut until", "cold lake lies deep below", "last train leaves here before"]
    letters = "abcdefghij"
    word = lambda k, i: f"{'xyz'[k]}{letters[i // 10]}{letters[i % 10]}"
    rows = [(40 * k + i, f"all of the {end} {word(k, i)}") for k, end in enumerate(ends) for i in range(40)]
    # A leaf whose lines have little in common keeps them all.
    rows += [(500 + i, f"one of these {' '.join(RNG.choice(letters) + RNG.choice(letters) for _ in range(7))}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_recurring(df).collect()}
    assert [i for i in range(120) if not got[i]] == [0, 40, 80]
    assert not any(got[500 + i] for i in range(30))


def test_whole_rule_on_many_shapes(spark):
    """Lines of all lengths, several templates a node, words that repeat by chance: as the rule says, in any order."""
    rng = random.Random(17)
    few = ["".join(rng.choice("abcd") for _ in range(2)) for _ in range(12)]
    line = lambda: " ".join(rng.choice(few) for _ in range(rng.randrange(1, 13)))
    base = [line() for _ in range(60)]

    def changed(text):
        words = text.split()
        words[rng.randrange(len(words))] = rng.choice(few)
        return " ".join(words)

    rows = [(i, "\n".join(changed(rng.choice(base)) if rng.random() < 0.8 else line() for _ in range(12))) for i in range(60)]
    rows += [(200 + i, f"All rights reserved.\n{i}\n\n{i} left") for i in range(5)]
    for parts in (3, 11):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = rows_of(line_templates.drop_recurring(df, details=False), "doc_id", "text")
        assert got == sorted(lines_left(rows), key=repr)


def test_rows_pass_with_clashing_names(spark):
    """Columns named like the operators' own keep their values."""
    names = "doc_id long, text string, source string, row int, doc int, drop int, lines int, _row int, _order int, _nth int, order int, nth int, _drop int, _doc int, size int, key int"
    values = list(range(1, 14))
    rows = [(i, f"{prose(60)}\nsame old line of words here", "s", *values) for i in range(6)]
    df = spark.createDataFrame(rows, names)
    for made in (line_templates.drop_recurring(df, details=False), simhash.keep_one(df), mixing.mixed_documents(df)):
        assert made.columns == df.columns
        got = made.collect()
        assert got and all(list(r)[3:] == values for r in got)


# ------------------------------------------------------------------ licences


def test_licences_on_unseen_paragraphs(spark, docs):
    classifier = licences.train(docs)
    told = [
        ("This library is released under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0 by the team", ["Apache-2.0"]),
        ("All text here: licensed under CC BY-NC 4.0!", ["CC-BY-NC-4.0"]),
        ("this work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", ["GPL-3.0", "MIT"]),
        (prose(60), []),
        ("the general public was in the version of the work", []),
        (None, []),
        ("", []),
    ]
    rows = [(i, t, "x") for i, (t, _) in enumerate(told)] + [(None, told[0][0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences for r in licences.scan(df, classifier).collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(told)}, None: ["MIT"]}
    assert licences.scan(df.limit(0), classifier).count() == 0


def test_licence_held_out_accuracy(spark, docs):
    classifier = licences.train(docs)
    rng = random.Random(99)
    right = 0
    cases = [(family, notice) for family, own in licences.NOTICES.items() for notice in own if len(notice.split()) > 3]
    for family, notice in cases:
        text = f"{rng.choice(['here', 'our work', 'files'])} {notice} {rng.choice(['', 'thanks', 'in full'])}".upper()
        right += (classifier.predict(text) or ("", 0))[0] == family
    assert right >= 0.9 * len(cases)


def test_licences_wrapped_and_whole(spark, docs):
    """Notices over several lines, whole headers and licences that are none of the families; none is in the training."""
    classifier = licences.train(docs)
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the notice."""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License below."""
    told = [
        ("Some words first\nThis work is licensed under the GNU General Public\nLicense, version 3.\nmore words", ["GPL-3.0"]),
        (gpl, ["GPL-3.0"]),
        (bsd, ["BSD-2-Clause"]),
        (apache, ["Apache-2.0"]),
        ("Released under the Zorbago license", ["unknown"]),
        ("This work is licensed under the Felidra Public License, version 4.0", ["unknown"]),
        ("\n".join(prose(12) for _ in range(40)), []),
        ("the terms of the work are as follows and the public may use it\nunder the old bridge by the author", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(told)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(df, classifier).collect()}
    assert got == {i: want for i, (_, want) in enumerate(told)}


# ------------------------------------------------------------------ mixing


def test_mix_meets_targets(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source_size, r.target].append(r.taken)
    for (size, target), taken in by.items():
        assert sum(taken) == math.floor(target + 1e-9) and target <= 3 * size
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "size", "taken").collect()), key=repr)
    assert again == sorted(((r.doc_id, r.size, r.taken) for r in got), key=repr)


def test_mixed_documents_hold_what_the_mix_takes(docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r.doc_id].append(r.text or "")
    for r in mixed.collect():
        got[r.doc_id] += count(r.text)
        assert any(r.text in t or count(r.text) < count(t) for t in whole[r.doc_id])
    assert +got == +taken
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_blocks_are_permuted(spark, docs):
    sources = mixing.targets(mixing.sized(docs))
    for key, own in Counter((r.key, r.copy, r.block) for r in mixing.slots(sources).collect()).items():
        assert own == 1, key
    shards = mixing.shard_counts(sources).groupBy("shard").agg(F.sum("n_slots").alias("n")).collect()
    assert all(r.n <= mixing.SHARD_SLOTS + mixing.EXTRA * 8 for r in shards)


def test_shards_are_multinomial(spark, monkeypatch):
    """Counts of a source vary from shard to shard as a multinomial's do, and every slot stands in one shard."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 4)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    rows = [(i, "one two three four " * 50, f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = stage_table(mixing.targets(mixing.sized(df)))
    counts = defaultdict(dict)
    for r in mixing.shard_counts(sources).collect():
        counts[r.k][r.shard] = r.n_slots
    total = {k: sum(c.values()) for k, c in counts.items()}
    urn = sum(total.values())
    whole = range(urn // 64 * 4 // 5)
    for k, own in counts.items():
        p = total[k] / urn
        spread = np.var([own.get(s, 0) for s in whole])
        assert 0.6 < spread / (64 * p * (1 - p)) < 1.5
    blocks = mixing.mixed_blocks(df).groupBy("source", "slot").agg(F.count_distinct("shard").alias("n")).collect()
    assert all(r.n == 1 for r in blocks) and len(blocks) == urn


# ------------------------------------------------------------------ main text

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">Menu one</a></li><li>two</li></ul></nav>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;  words<br>go   on &lt;here&gt;.<p>Second <a href=x>link</a> text.
<div class="ad-box">Buy this thing</div><form><input value=x>Your name</form><p>Third.</p></article>
<aside>See also</aside><div id="comments"><p>I do not agree at all with this long text, says a reader.</p></div>
<footer>&copy; all</footer><!-- end --></body></html>"""
WANT = "Title & more\nFirst bold words go on <here>.\nSecond link text.\nThird."


def test_main_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_text.train(pages)
    assert html_text.main_text(PAGE, weights) == WANT
    plain = PAGE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert html_text.main_text(plain, weights) == WANT
    for page, want in [(None, ""), ("", ""), ("<p>a", "a"), ("<script>x", ""), ("1 < 2 words", "1 < 2 words"), ("<!-- open", ""), ("<p class='x", "")]:
        assert html_text.main_text(page, weights) == want
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long, weights) == "\n".join(["word & word"] * 20_000)
    rows = [(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = rows_of(html_text.extract(df, weights), "page_id", "url", "text", "n_chars")
    assert got == [(1, "u", WANT, len(WANT)), (1, "u", WANT, len(WANT)), (None, None, "", 0)]


def test_best_run_by_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 14))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        begin, end = html_text.best_run(scores)
        most = max(sums.values(), default=0.0)
        assert (begin, end) == (0, 0) if most <= 0 else sums[begin, end] == most


def test_region_is_found_by_score(spark):
    """No mark and no single name decides: the largest region does."""
    weights = html_text.train(spark.read.parquet(f"{SMALL}/pages.parquet"))
    own = [" ".join(f"word{i}" for i in range(40))] * 6
    story = "".join(f"<p>{p}</p>" for p in own)
    card = "<article><p>Short teaser card.</p></article>"
    for page in (f"<body>{card}<div class='content'>{story}</div></body>", f"<div class='post share-enabled'>{story}</div>{card}", f"<div id='main-form'>{story}</div>"):
        for w in (weights, html_text.Weights()):
            assert html_text.main_text(page, w) == "\n".join(own)
    deep = "<div>" * 100_000 + "text" + "</div>" * 100_000
    assert html_text.main_text(deep, weights) == "text"


def test_main_text_of_the_pages_is_their_article(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages, html_text.train(pages)).collect():
        article = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


# ------------------------------------------------------------------ language models


def test_scores_by_hand(spark):
    rows = [(i, prose(RNG.randrange(1, 30))) for i in range(60)] + [(None, "a b"), (7, None), (8, ""), (3, "again a b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    target = lambda i: i is not None and i % 3 == 0
    models = lm_scores.train(df, F.col("doc_id") % 3 == 0)
    half = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", lm_scores._half("doc_id").alias("h")).collect()}
    size = len({w for _, t in rows for w in (t or "").split()}) + 1
    alone, pair, total = defaultdict(Counter), defaultdict(Counter), Counter()
    for i, t in rows:
        words = (t or "").split()
        for model in [1] + [0] * target(i):
            key = (1 - half[i, t], model)
            alone[key].update(words)
            pair[key].update(zip([None, *words], words, strict=False))
            total[key] += len(words)

    def loss(words, key):
        out = []
        for a, b in zip([None, *words], words, strict=False):
            p = (alone[key][b] + 1) / (total[key] + size)
            seen = total[key] if a is None else alone[key][a]
            out.append(-math.log(0.6 * (min(pair[key][a, b], seen) / seen if seen else p) + 0.4 * p))
        return sum(out) / len(out)

    for r, (i, t) in zip(sorted(lm_scores.score(df, models).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words)), sorted(rows, key=lambda r: (r[0] is None, r[0], len((r[1] or "").split()))), strict=True):
        words = (t or "").split()
        assert r.n_words == len(words)
        if not words:
            assert r.target_loss is None and r.score is None
            continue
        assert r.target_loss == pytest.approx(loss(words, (half[i, t], 0)), rel=1e-9)
        assert r.background_loss == pytest.approx(loss(words, (half[i, t], 1)), rel=1e-9)
        assert r.score == pytest.approx(r.target_loss - r.background_loss)
    assert lm_scores.score(df.limit(0), lm_scores.train(df.limit(0), F.lit(True))).count() == 0


def test_scores_of_many_words_and_pairs(spark, monkeypatch):
    """No word and no pair is lost or merged, however many there are and however they are dealt."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(60_000)}" if rng.random() < 0.7 else f"c{rng.randrange(3)}" for _ in range(900))) for i in range(120)]
    rows += [(500, rows[1][1]), (501, rows[1][1]), (None, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    half = {r.doc_id: r.h for r in df.select("doc_id", lm_scores._half("doc_id").alias("h")).collect()}
    alone, pair = defaultdict(Counter), defaultdict(Counter)
    for i, t in rows:
        for model in [1] + [0] * (i is not None and i % 3 == 0):
            alone[1 - half[i], model].update(t.split())
            pair[1 - half[i], model].update(zip([None, *t.split()], t.split(), strict=False))
    total = {k: sum(c.values()) for k, c in alone.items()}
    size = len({w for _, t in rows for w in t.split()}) + 1
    assert size > 1 << 15
    wanted = {}
    for i, t in rows:
        words, means = t.split(), []
        for key in ((half[i], 0), (half[i], 1)):
            p = [(alone[key][w] + 1) / (total[key] + size) for w in words]
            seen = [total[key], *[alone[key][w] for w in words[:-1]]]
            both = [pair[key][ab] / n if n else q for ab, n, q in zip(zip([None, *words], words, strict=False), seen, p, strict=True)]
            means.append(-sum(math.log(0.6 * b + 0.4 * q) for b, q in zip(both, p, strict=True)) / len(words))
        wanted[i] = means
    ids = spark.createDataFrame([(i,) for i, _ in rows if i is not None and i % 3 == 0], "doc_id long")
    again = df.select("*")
    for size, target, asked in ((1 << 24, F.col("doc_id") % 3 == 0, df), (20_000, ids, df), (50_000, ids, again)):
        monkeypatch.setattr(lm_scores, "PIECE_BYTES", size)
        monkeypatch.setattr(lm_scores, "BUCKET_BYTES", size)
        got = lm_scores.score(asked, lm_scores.train(df, target)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert [r.target_loss, r.background_loss] == pytest.approx(wanted[r.doc_id], rel=1e-9)


# ------------------------------------------------------------------ tokens


def test_lexicon_is_minimal_and_exact():
    words = sorted({f"{a}{b}".encode() for a in ("", "re", "un", "ünter") for b in ("doing", "going", "do", "go", "gone")})
    entries = {w: np.array(list(w) * 2, dtype=np.uint32) for w in words}
    content = compile_lexicon(entries)
    found = Lexicon.of(content)
    assert all(found.get(w) == v.tobytes() for w, v in entries.items())
    assert found.get(b"") is None and found.get(b"goin") is None and found.get(b"goings") is None
    assert int(np.frombuffer(content, np.int32, 1)[0]) < sum(map(len, words)) / 2
    assert Lexicon.of(compile_lexicon({})).get(b"x") is None


def test_lexicon_leaves_no_file(tmp_path, monkeypatch):
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    assert Lexicon.of(compile_lexicon({b"do": np.array([7], np.uint32)})).get(b"do") == np.array([7], "<u4").tobytes()
    assert not list(tmp_path.iterdir())


def test_encoding_is_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = bpe.round_trip(docs, TOKENIZER)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    encoded = bpe.encode(docs, TOKENIZER)
    texts_back = bpe.decode(encoded, TOKENIZER).select("doc_id", F.sha2(F.col("decoded").cast("binary"), 256).alias("d"))
    assert rows_of(texts_back, "doc_id", "d") == sorted(((w[0], w[3]) for w in want), key=repr)
    assert bpe.round_trip(docs.limit(0), TOKENIZER).count() == 0


def test_merging_without_a_lexicon_is_the_librarys():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(TOKENIZER), bpe.Encoder(bpe.Merges(TOKENIZER))
    odd = ["don't I'LL we've '", "aaaa" * 40, "ΟΔΟΣ Σ", "İstanbul ẞ", "é ﬁ", "a\x1cb\x1d c", "日本語 テスト 😀", "1234 ½ Ⅷ", "x\u0085y　w"]
    for text, ids in zip(odd, coder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages_keep_their_promises(spark):
    source = docs_in = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_in = stage_table(stage(spark, docs_in, SMALL), "test-stage")
        after[name] = docs_in
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs_in.columns == source.columns
    assert list(named) == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "bpe_encoding"]
    ids = lambda name: {r.doc_id for r in after[name].select("doc_id").collect()}
    good = {r.doc_id for r in quality_rules.verdicts(quality_rules.ledger(source)).filter("kept").collect()}
    assert ids("quality_rules") == good
    left = {i: t for i, t in lines_left([(r.doc_id, r.text) for r in after["quality_rules"].collect()])}
    assert {r.doc_id: r.text for r in after["line_dedup"].collect()} == {i: t for i, t in left.items() if t.split()}
    groups = defaultdict(list)
    prints = {r.doc_id: print_of(r.text) for r in after["line_dedup"].collect()}
    root = smallest_reachable(sorted(set(prints.values())), [(a, b) for a, b in combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 2])
    for i, p in prints.items():
        groups[root[p]].append(i)
    assert ids("near_dedup") == {min(g) for g in groups.values()}
    words = lambda name: sum(measured(r.text)[0] for r in after[name].collect())
    assert abs(words("source_mixing") - words("near_dedup")) <= 21
    assert after["bpe_encoding"].count() == after["source_mixing"].count()
    assert corpus_pipeline.run(spark, SMALL).count() == after["bpe_encoding"].count()
