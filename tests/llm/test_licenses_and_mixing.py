import collections
import textwrap

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from scanlake.llm import license_scan as L
from scanlake.llm import mixing as M

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.license, r.n_missing, r.n_added) for r in L.license_scan(df).collect())


def test_exact_and_changed_notices(spark):
    mit = L.TEMPLATES["MIT grant"]
    got = found(
        spark,
        "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.",
        f"x\n{mit.replace('charge', 'cost')}\ny",
        "Released under the MIT License. And then: Licensed under CC BY-SA 4.0.",
        "He had a license to drive and asked permission to copyright the public domain.",
        "This work is licensed under the GNU General Public License, version 2.",
        " ".join(t for n, t in L.TEMPLATES.items() if n[-1] == "0"),
        "THIS WORK IS LICENSED UNDER THE GNU LESSER GENERAL PUBLIC LICENSE, VERSION 3.",
    )
    assert got == [(0, "Apache-2.0", 0, 0), (1, "MIT grant", 1, 1), (2, "CC-BY-SA-4.0", 0, 0), (2, "MIT", 0, 0), (4, "GPL-2.0", 0, 0), *[(5, n, 0, 0) for n in sorted(L.TEMPLATES) if n[-1] == "0"], (6, "LGPL-3.0", 0, 0)]


def test_every_line_of_the_documents(spark, sf_dir):
    """Against a plain search for the templates' wording in each line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r.doc_id, name) for r in docs.collect() for line in (r.text or "").split("\n") for name, t in L.TEMPLATES.items() if t.lower() in line.lower())
    assert want and sorted((r.doc_id, r.license) for r in L.license_scan(docs).collect()) == want


def test_license_edges(spark, edge_docs, no_docs):
    assert L.license_scan(edge_docs).count() == 0 and L.license_scan(no_docs).count() == 0
    far = "word " * 50_000 + "Released under the MIT License." + " word" * 50_000
    got = L.license_scan(spark.createDataFrame([(1, far), (1, far)], "doc_id long, text string")).collect()
    assert [(r.license, r.n_missing) for r in got] == [("MIT", 0)] * 2 and all(r.start <= 250_000 < r.end for r in got)


@pytest.fixture(scope="module")
def mixed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return M.mixed(docs, {"source": 0.5, "lang": 0.5, "topic": 0.5}, 0.5, MODEL).collect()


def test_weights_equal_plain_fitting(mixed):
    """The same raking on a dictionary of cells."""
    cells = collections.Counter()
    for r in mixed:
        cells[r.row.source, r.row.lang, r.topic] += r.n_tokens
    cells = {k: v for k, v in cells.items() if v}
    keys, w = list(cells), np.array([float(v) for v in cells.values()])
    targets = []
    for m in range(3):
        sums = collections.Counter()
        for k, v in cells.items():
            sums[k[m]] += v
        total = sum(v**0.5 for v in sums.values())
        targets.append({k: v**0.5 / total for k, v in sums.items()})
    for _ in range(300):
        for m in range(3):
            now = collections.Counter()
            for k, x in zip(keys, w, strict=True):
                now[k[m]] += x
            w *= [targets[m][k[m]] / now[k[m]] for k in keys]
    want = dict(zip(keys, w, strict=True))
    for r in mixed:
        if r.n_tokens:
            assert abs(r.weight - want[r.row.source, r.row.lang, r.topic]) < 1e-3 * max(want.values())


def test_joins_rake_as_one_task_does(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(f"s{i}", f"l{j}", int(rnd.integers(1, 900))) for i in range(6) for j in range(4) if (i + j) % 5]
    cells = spark.createDataFrame(rows, "a string, b string, mass long")
    targets = {"a": M.tempered(cells, "a", 0.3), "b": M.tempered(cells, "b", 0.0)}
    one = {(r.a, r.b): r.weight for r in M.raked(cells, targets).collect()}
    monkeypatch.setattr(M, "IN_ONE_TASK", 0)
    other = {(r.a, r.b): r.weight for r in M.raked(cells, targets).collect()}
    assert one.keys() == other.keys() == {r[:2] for r in rows} and all(abs(one[k] - other[k]) < 1e-5 for k in one)


def test_expected_tokens(mixed):
    total = sum(r.n_tokens for r in mixed)
    assert abs(sum(r.n_tokens * r.probability for r in mixed) - 0.5 * total) < 0.01 * total
    assert 0.3 * total < sum(r.n_tokens for r in mixed if r.kept) < 0.7 * total
    assert all(0 <= r.probability <= 1 for r in mixed)


def test_mixing_edges(spark, edge_docs, no_docs):
    got = M.mixed(edge_docs, {"source": 0.5, "lang": 0.5, "topic": 0.5}, 0.9, MODEL).collect()
    assert len(got) == edge_docs.count()
    assert all(r.kept and r.topic == "empty" for r in got if r.row.doc_id in (1, 2, 3))
    assert len({r.kept for r in got if r.row.doc_id == 5}) == 1
    assert M.mixed(no_docs, {"source": 0.5, "topic": 0.5}, 0.5, MODEL).count() == 0


def test_masses_are_tokens_of_the_library(mixed):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r.n_tokens == len(library.encode(r.row.text or "")) for r in mixed[::7])
    assert all(r.off <= M.TOLERANCE for r in mixed if r.n_tokens)


def test_topics_of_unseen_texts(spark, monkeypatch):
    """Three vocabularies: topics fitted on a third of the texts tell the vocabularies of the others apart."""
    rnd = np.random.default_rng(5)
    kind = rnd.integers(0, 3, 300)
    texts = [" ".join(f"{'abc'[k]}{i}" for i in rnd.integers(0, 80, rnd.integers(20, 90))) for k in kind]
    vectors = M.word_vectors(*M.numbered(pa.array([*texts, None, "", " \n"])))
    assert not vectors[300:].any()
    monkeypatch.setattr(M, "TOPICS", 3)
    table = lambda x: spark.createDataFrame([(v.tobytes(),) for v in x.astype("<f2")], "vector binary").repartition(3)
    weights, centres = M.fit_topics(table(vectors[:100]))
    found = (M.directions(vectors[100:300], weights) @ centres.T).argmax(axis=1)
    assert len({(int(f), int(k)) for f, k in zip(found, kind[100:], strict=True)}) == 3
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*texts[:60], None])], "doc_id long, text string, topic string").repartition(3)
    got = {r.row.doc_id: r for r in M.mixed(df, {"topic": 0.5}, 0.9, MODEL).collect()}
    assert len({(r.topic, kind[i]) for i, r in got.items() if i < 60}) == 3 and got[60].topic == "empty" and got[5].row.topic == "s"
    again = {r.row.doc_id: r.topic for r in M.mixed(df.coalesce(1), {"topic": 0.5}, 0.9, MODEL).collect()}
    assert again == {i: r.topic for i, r in got.items()}


def test_topics_are_fitted_to_all_rows(spark, monkeypatch):
    """Every sweep in numpy over all rows, a third of which are copies of one; neither their order nor their partitions matter."""
    monkeypatch.setattr(M, "STARTS", 6)
    monkeypatch.setattr(M, "ROUNDS", 4)
    rnd = np.random.default_rng(1)
    vectors = np.sqrt(rnd.poisson(0.2, (900, M.DIMENSIONS)) + 3 * (rnd.integers(0, 12, 900)[:, None] == np.arange(M.DIMENSIONS) % 12)).astype("<f2")
    vectors[::3] = vectors[0]
    table = lambda x, n: spark.createDataFrame([(v.tobytes(),) for v in x], "vector binary").repartition(n)
    weights, centres = M.fit_topics(table(vectors, 5))
    again = M.fit_topics(table(vectors[rnd.permutation(900)], 2))
    assert (again[0] == weights).all() and (again[1] == centres).all() and len(centres) == 6
    assert np.allclose(weights, np.log(901 / ((vectors > 0).sum(axis=0) + 1)) + 0.01, atol=1e-5)
    x = M.directions(vectors.astype(np.float32), weights)
    hashes = {}
    for r in table(vectors, 1).selectExpr("xxhash64(vector) as h", "vector").collect():
        hashes[r.h] = np.frombuffer(r.vector, "<f2").astype(np.float32)
    want = M.first_centres(M.directions(np.stack([hashes[h] for h in sorted(hashes)[:6]]), weights), 0)
    for _ in range(4):
        own = (x @ want.T).argmax(axis=1)
        size = np.bincount(own, minlength=len(want))
        want = np.stack([v / np.linalg.norm(v) for v in (x[own == k].astype(float).sum(axis=0) if size[k] else want[k] for k in range(len(want)))]).astype(np.float32)
    assert np.allclose(centres, want[np.argsort(-size, kind="stable")], atol=1e-4)
    none = M.fit_topics(table(vectors[:0], 1))
    assert none[1].shape == (0, M.DIMENSIONS)


def test_few_long_texts_are_numbered_together(monkeypatch):
    """Pieces of a batch hold so many bytes at most, or one text, and all rows in order."""
    monkeypatch.setattr(M, "TOGETHER", 100)
    texts = [None, "", *(["x" * 30] * 8), "y" * 400, "z" * 100, None, "é" * 50, "a"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
    pieces = list(M.together([batch, batch.slice(0, 0), batch.slice(9)]))
    assert [t for p in pieces for t in p.column(1).to_pylist()] == texts + texts[9:]
    sizes = [[len((t or "").encode()) for t in p.column(1).to_pylist()] for p in pieces]
    assert all(len(s) == 1 or sum(s) <= 100 for s in sizes) and len(sizes[0]) == 5


def test_what_cannot_be_met_is_reported(spark):
    """Cells without mass make these targets contradict each other."""
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "m string, n string, mass long")
    targets = {"m": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "m string, share double"), "n": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "n string, share double")}
    for most in (100_000, 0):
        M.IN_ONE_TASK, kept = most, M.IN_ONE_TASK
        try:
            assert all(r.off > 0.5 for r in M.raked(cells, targets, sweeps=3).collect())
        finally:
            M.IN_ONE_TASK = kept


def test_wrapped_notices(spark):
    """Every template hard-wrapped, plain and as comments, alone and amid lines of prose; two changed copies do not hide each other."""
    prose = "He went home by the river and said that it was late, as it was every day of the year.\n" * 6
    marks = ("", "// ", "//", " * ", "# ", "-- ", "    ; ")
    wrapped = {n: textwrap.wrap(t, 40, break_long_words=False, break_on_hyphens=False) for n, t in L.TEMPLATES.items()}
    texts = [around + "\n".join(m + line for line in lines) + "\n" + around for lines in wrapped.values() for m in marks for around in ("", prose)]
    mit = wrapped["MIT grant"]
    twice = "\n".join(mit).replace("associated", "attached") + "\n" + "\n".join(mit).replace("charge", "cost")
    want = [(i, n, 0, 0) for i, n in enumerate(n for n in wrapped for _ in range(2 * len(marks)))]
    assert found(spark, *texts, twice) == [*want, *[(len(want), "MIT grant", 1, 1)] * 2]


def test_blocks_end_with_the_paragraph():
    assert L.blocks(b"one\n\ntwo\nlicense three\nfour \n \nfive") == [(5, 28)]
    assert L.blocks(b"x" * 2000 + b"license" + b"y" * 2000, 700) == [(1300, 2706)]


MIT = "MIT License\n\nCopyright (c) 2020 Somebody\n\n{MIT grant}, {MIT rights}\n\n{MIT conditions}\n\n{MIT warranty}\n"
BSD = "Copyright 2019 Somebody. All rights reserved.\n\n{BSD-3-Clause}\n\n{BSD-2-Clause conditions}\n\n%s{BSD disclaimer}\n"
TEXTS = {
    "MIT": MIT,
    "BSD-2-Clause": BSD % "",
    "BSD-3-Clause": BSD % "3. {BSD-3-Clause endorsement}\n\n",
    "ISC": "Copyright 2018 Somebody\n\n{ISC}\n\n{ISC warranty}\n",
    "Apache-2.0": "Copyright 2021 Somebody\n\n{Apache-2.0 header}\n\n{Apache-2.0 terms}\n",
    "GPL-3.0-or-later": "{GPL-3.0-or-later header}\n\n{GPL warranty}\n",
    "GPL-2.0-or-later": "{GPL-2.0-or-later header}\n\n{GPL warranty}\n",
    "MPL-2.0": "{MPL-2.0} {MPL-2.0 copy}\n",
    "Unlicense": "{Unlicense}\n\n{Unlicense grant}\n",
}


def full(name):
    text = TEXTS[name]
    for part in sorted(L.TEMPLATES, key=len, reverse=True):
        text = text.replace("{" + part + "}", L.TEMPLATES[part])
    return text


def merged(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.license, r.whole) for r in L.licenses(df).collect())


def test_a_whole_license_is_one_row(spark):
    texts = [full(n) for n in TEXTS]
    assert merged(spark, *texts) == sorted((i, n, True) for i, n in enumerate(TEXTS))
    assert merged(spark, L.TEMPLATES["MIT grant"], L.TEMPLATES["BSD disclaimer"], L.TEMPLATES["GPL warranty"]) == [(0, "MIT", False), (1, "BSD", False), (2, "GPL", False)]


def test_tags_and_references(spark):
    texts = ["# SPDX-License-Identifier: MIT\nimport os", "/* SPDX-License-Identifier: GPL-3.0-or-later */", "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC", "SPDX-License-Identifier: Nothing-1.0"]
    texts += ["Licensed under the GNU GPL v3", "It is distributed under the terms of the MIT license. Have fun.", "SPDX-License-Identifier: 0BSD"]
    want = [(0, "MIT"), (1, "GPL-3.0-or-later"), (2, "Apache-2.0"), (2, "ISC"), (2, "MIT"), (4, "GPL-3.0"), (5, "MIT"), (6, "0BSD")]
    assert [r[:2] for r in merged(spark, *texts)] == want


def test_precision_and_recall_on_changed_licenses(spark):
    """A word in forty replaced, dropped or added, wrapped anew, as plain text or comment, amid prose; and texts of the same words out of order."""
    rnd = np.random.default_rng(4)
    prose = "He went home by the river and said that it was late, as it was every day of the year.\n\n"
    texts, want = [], []
    for name in TEXTS:
        for mark in ("", "// ", " * ") * 5:
            lines = []
            for paragraph in full(name).split("\n\n"):
                words = []
                for w in paragraph.split():
                    what = rnd.integers(0, 120)
                    words += [] if what == 0 else ["thing"] if what == 1 else [w, "really"] if what == 2 else [w]
                lines += [*(mark + x for x in textwrap.wrap(" ".join(words), int(rnd.integers(45, 90)))), ""]
            want.append((len(texts), name))
            texts.append(prose + "\n".join(lines) + "\n" + prose)
        shuffled = full(name).split()
        rnd.shuffle(shuffled)
        texts.append(" ".join(shuffled))
    got = {r[:2] for r in merged(spark, *texts)}
    right = len(got & set(want))
    assert right >= 0.97 * len(want) and right >= 0.97 * len(got), (right, len(want), len(got), *sorted(got ^ set(want)))
