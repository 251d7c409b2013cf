"""Licence notices by a trained paragraph classifier.

A paragraph is a line, and also every run of neighbouring lines that share word pairs with some licence notice, so
a notice that is wrapped over lines is read as one. A multinomial logistic regression on the words and word pairs
that occur in licence notices, trained here, gives a paragraph a licence family, *unknown* (a notice of a licence
that is none of these) or none. It is trained on the notices below, varied at random, on notices of made-up
licences, and on a bounded sample of the corpus' own paragraphs as counter-examples, chosen by a hash (``OTHERS`` at
most). A held-out part of all three calibrates the probabilities of all classes (one temperature) and sets the bar
under which nothing is claimed: what no held-out counter-example exceeds, within ``BARS``. The prediction of a family
is confirmed if the paragraph holds ``CONFIRM`` of the word pairs of a notice of that family (of a made-up one
without its name, if it is unknown); with ``RESEMBLE`` of
them its licence is unknown too, with fewer it is no notice.

Documents are scored where they lie; nothing is shuffled.

Cases: null and empty texts have no paragraph and no licence. A text of many licences gives them all, in order
of name. One row out for each row in, null and repeated ids included. An empty table gives an empty result.
Other columns are ignored. A paragraph of any length is scored whole.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: Counter-examples from the corpus, variants of each notice, held-out share (one in).
OTHERS = 4000
VARIANTS = 60
HELD_OUT = 4
#: A word or pair must occur in so many varied notices to be a feature.
SEEN = 3
CONFIRM = 0.8
RESEMBLE = 0.5
BARS = (0.8, 0.98)
SEED = 11
NONE = "none"
UNKNOWN = "unknown"
WORDS = regex.compile(r"[\p{L}\p{N}]+(?:[.\-/+'][\p{L}\p{N}]+)*").findall

# Usual notices, standard headers and first paragraphs of licence families.
NOTICES = {
    "AGPL-3.0": [
        "licensed under the gnu affero general public license, version 3",
        "released under the agpl 3.0",
        "it under the terms of the gnu affero general public license as published by the free software foundation, either version 3",
    ],
    "Apache-2.0": [
        "licensed under the apache license, version 2.0",
        "apache license, version 2.0",
        "apache license version 2.0, january 2004",
        'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license',
    ],
    "BSD-2-Clause": [
        "licensed under the bsd 2-clause license",
        "released under the simplified bsd license",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "licensed under the bsd 3-clause license",
        "released under the new bsd license",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC0-1.0": ["released under cc0 1.0", "dedicated to the public domain under the cc0 1.0 universal dedication"],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license, version 2",
        "released under the gpl 2.0",
        "it under the terms of the gnu general public license as published by the free software foundation; either version 2",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license, version 3",
        "released under the gpl 3.0",
        "it under the terms of the gnu general public license as published by the free software foundation, either version 3",
    ],
    "ISC": ["released under the isc license", "permission to use, copy, modify, and/or distribute this software for any purpose"],
    "LGPL-3.0": [
        "licensed under the gnu lesser general public license, version 3",
        "released under the lgpl 3.0",
        "it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3",
    ],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license, v. 2.0", "licensed under the mozilla public license, version 2.0"],
    "Proprietary": ["all rights reserved", "copyright, all rights reserved by the author"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}
CLASSES = [NONE, UNKNOWN, *sorted(NOTICES)]
#: How licences outside the families are named in their notices; the name is made up.
STRANGERS = [
    "released under the {} license",
    "licensed under the {} license, version {n}",
    "this work is licensed under the {} public license, version {n}.0",
    "licensed under {} {n}.0",
    "it under the terms of the {} license as published by its authors, either version {n}",
    "distributed under the terms of the {} open licence",
]


def terms(paragraph: str) -> set[str]:
    """Lower-case words and pairs of neighbours."""
    words = WORDS(paragraph.lower())
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def pairs(paragraph: str) -> set[str]:
    words = WORDS(paragraph.lower())
    return set(map(" ".join, zip(words, words[1:], strict=False)))


def stranger_pairs(notice: str) -> set[str]:
    """The word pairs of a notice that hold nothing of its licence's name."""
    return set().union(*(pairs(part) for part in notice.replace("{n}", "{}").split("{}")))


def _variants() -> list[tuple[str, int]]:
    """Notices as they may stand in a text: other first words, something after them, a word lost."""
    rng = random.Random(SEED)
    starts = ["", "", "", "this project is ", "the code is ", "note: ", "copyright (c) 2020 the authors. ", "this file is ", "the content of this page is "]
    ends = ["", "", "", ".", " (the license).", ". see the file for details.", ", with no warranty.", " by its authors."]
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))
    told = [(notice, family) for family, own in NOTICES.items() for notice in own]
    told += [(notice, UNKNOWN) for notice in STRANGERS]
    out = []
    for notice, family in told:
        for _ in range(VARIANTS):
            words = notice.format(name(), n=rng.randrange(1, 9)).split() if family == UNKNOWN else notice.split()
            if len(words) > 6 and rng.random() < 0.2:
                del words[rng.randrange(len(words))]
            out.append((rng.choice(starts) + " ".join(words) + rng.choice(ends), CLASSES.index(family)))
    return out


def _softmax(raw: np.ndarray, temperature: float) -> np.ndarray:
    scaled = raw / temperature
    scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return scaled / scaled.sum(axis=1, keepdims=True)


@dataclass
class Classifier:
    """Weights per feature and class, calibration, and the notices' word pairs; all of fixed size."""

    features: dict[str, int]
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float
    bar: float

    def __post_init__(self) -> None:
        self.notice_pairs = {p for own in NOTICES.values() for n in own for p in pairs(n)}
        self.notice_words = {w for p in self.notice_pairs for w in p.split()}

    def raw(self, paragraph: str) -> np.ndarray:
        get = self.features.get
        hits = [i for t in terms(paragraph) if (i := get(t)) is not None]
        return self.intercept + self.weights[hits].sum(axis=0)

    def paragraphs(self, text: str) -> Iterator[str]:
        """The lines of a text, and its runs of lines that share a word pair with a notice."""
        run: list[str] = []
        for line in [*text.split("\n"), ""]:
            if line:
                yield line
            if line and not self.notice_words.isdisjoint(WORDS(line.lower())) and not self.notice_pairs.isdisjoint(pairs(line)):
                run.append(line)
                continue
            if len(run) > 1:
                yield " ".join(run)
            run = []

    def predict(self, paragraph: str) -> tuple[str, float] | None:
        """Licence (or unknown) and probability, None if it is no notice."""
        raw = self.raw(paragraph)
        best = int(raw.argmax())
        if best == 0:
            return None
        probability = float(_softmax(raw[None], self.temperature)[0, best])
        if probability < self.bar:
            return None
        family = CLASSES[best]
        own = pairs(paragraph)
        if family == UNKNOWN:
            likeness = max(len(own & wanted) / len(wanted) for wanted in map(stranger_pairs, STRANGERS))
            return (UNKNOWN, probability) if likeness >= CONFIRM else None
        likeness = max(len(own & wanted) / len(wanted) for wanted in map(pairs, NOTICES[family]))
        if likeness < RESEMBLE:
            return None
        return (family if likeness >= CONFIRM else UNKNOWN), probability


def _counter_examples(docs: DataFrame, text_col: str) -> list[str]:
    """Paragraphs of the corpus chosen by hash, none that repeats half a notice."""
    every = max(1, docs.count() * 10 // OTHERS)
    lines = docs.select(F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("paragraph"))
    chosen = lines.filter((F.pmod(F.xxhash64("paragraph"), F.lit(every)) == 0) & (F.length("paragraph") > 0))
    rows = chosen.distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(OTHERS).collect()
    notices = [pairs(n) for own in NOTICES.values() for n in own]
    return [r.paragraph for r in rows if max(len(w & pairs(r.paragraph)) / len(w) for w in notices) < 0.5]


def train(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Fit on the notices and a bounded sample of the corpus; calibrate on what was held out."""
    varied = _variants()
    counts = Counter(t for paragraph, _ in varied for t in terms(paragraph))
    features = {t: i for i, t in enumerate(sorted(t for t, n in counts.items() if n >= SEEN))}
    told = [*varied, *((p, 0) for p in _counter_examples(docs, text_col))]
    random.Random(SEED).shuffle(told)
    held, fitted = told[: len(told) // HELD_OUT], told[len(told) // HELD_OUT :]
    rows = []
    for paragraph, label in fitted:
        hits = sorted({features[t] for t in terms(paragraph) if t in features})
        rows.append((float(label), Vectors.sparse(len(features), hits, [1.0] * len(hits))))
    table = docs.sparkSession.createDataFrame(rows, ["label", "features"])
    regression = LogisticRegression(family="multinomial", regParam=1e-4, elasticNetParam=0.5, maxIter=80)
    model = regression.fit(table.repartition(4))
    found = model.coefficientMatrix.toArray()
    weights = np.zeros((len(features), len(CLASSES)))
    intercept = np.full(len(CLASSES), -1e3)
    weights[:, : len(found)], intercept[: len(found)] = found.T, model.interceptVector.toArray()
    plain = Classifier(features, weights, intercept, 1.0, 0.0)
    scores, truth = np.stack([plain.raw(p) for p, _ in held]), np.array([c for _, c in held])
    loss = lambda t: -np.log(_softmax(scores, t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    others = _softmax(scores[truth == 0], temperature)[:, 1:]
    bar = float(np.clip(others.max(initial=0.0), *BARS))
    return Classifier(features, weights, intercept, temperature, bar)


def scan(docs: DataFrame, trained: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_paragraphs (that read like a notice), licences (sorted), probability (the best).

    A text with a confirmed licence is not called unknown as well.
    """
    shared = Shared(docs.sparkSession, trained)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        predict = classifier.predict
        for batch in batches:
            counts, names, best = [], [], []
            for text in batch.column(1):
                found = [p for paragraph in classifier.paragraphs(text.as_py() or "") if (p := predict(paragraph))]
                # A part of a wrapped notice is no licence of its own.
                named = [p for p in found if p[0] != UNKNOWN]
                found = named or found
                counts.append(len(found))
                names.append(sorted({name for name, _ in found}))
                best.append(max((p for _, p in found), default=None))
            columns = [
                batch.column(0),
                pa.array(counts, pa.int64()),
                pa.array(names, pa.list_(pa.string())),
                pa.array(best, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_paragraphs", "licences", "probability"])

    kind = slim.schema["id"].dataType.simpleString()
    told = slim.mapInArrow(run, f"id {kind}, n_paragraphs long, licences array<string>, probability double")
    return told.withColumnRenamed("id", id_col)
