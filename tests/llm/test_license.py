import textwrap
import time

from ledgerlens.llm import license

from .helpers import documents, empty_documents, odd_documents

MIT = license.TEMPLATES[3][1]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license.scan_licenses(docs).collect()}


def test_notices_inside_texts(spark):
    got = scan(spark, [
        "Some prose. Released under the MIT License.\nMore prose here.", "x\nLicensed under CC BY-NC 4.0.\ny",
        "Licensed under CC BY 4.0.", "We licensed nothing and copyright is dull.",
        "Intro line.\n" + MIT.replace("to deal in", "\nto deal in") + "\nEnd.", MIT.replace("furnished", "given").upper(),
        "This work is licensed under the GNU General Public License, version 3."])
    assert {i: (r.license, r.exact) for i, r in got.items()} == {
        0: ("MIT", True), 1: ("CC-BY-NC-4.0", True), 2: ("CC-BY-4.0", True), 4: ("MIT", True), 5: ("MIT", False), 6: ("GPL-3.0", True)}
    assert "MIT License" in "Some prose. Released under the MIT License."[got[0].start:got[0].end]
    assert got[5].missing == 1 and got[5].extra == 1


def test_like_licenses_are_told_apart(spark):
    texts = [t for _, t in license.TEMPLATES]
    got = scan(spark, texts)
    assert {i: r.license for i, r in got.items()} == {i: n for i, (n, _) in enumerate(license.TEMPLATES)}
    assert all(r.exact for r in got.values())


def test_test_tables_against_their_lines(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = sorted((r.doc_id, lines[x]) for r in docs.collect() for x in r.text.split("\n") if x in lines)
    assert sorted((r.doc_id, r.license) for r in license.scan_licenses(docs).collect()) == want


def test_odd_documents(spark):
    assert license.scan_licenses(odd_documents(spark)).count() == 0
    assert license.scan_licenses(empty_documents(spark)).count() == 0


def test_wrapped_templates(spark):
    """Every template in lines of 40, 60 and 72 columns, among other lines."""
    want, texts = [], []
    for width in (40, 60, 72):
        for name, t in license.TEMPLATES:
            want.append(name)
            texts.append("First line of a file.\n\n" + textwrap.fill(t, width, break_long_words=False, break_on_hyphens=False) + "\n\nimport this\n")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license.scan_licenses(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == list(enumerate(want))
    assert all(r.exact for r in rows)


def test_dense_hints_and_long_sentences(spark):
    """A wrapped text amid many hinted lines at any place, several notices in one text, and one in a sentence without stops."""
    wrapped, mpl = textwrap.fill(MIT, 60), textwrap.fill(license.TEMPLATES[10][1], 60)
    dull = "the permission line number {} says nothing\n"
    texts = ["".join(dull.format(i) for i in range(n)) + wrapped + "\n" + "".join(dull.format(i) for i in range(60)) for n in range(0, 120, 7)]
    got = scan(spark, texts)
    assert {i: r.license for i, r in got.items()} == dict.fromkeys(range(len(texts)), "MIT")
    long = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(0, f"{mpl}\n\nand\n\n{wrapped}\n\nand\n\n{mpl}"), (1, f"{long} Licensed under CC BY 4.0 {long}")],
                                 "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in license.scan_licenses(docs).collect()) == [
        (0, "MIT"), (0, "MPL-2.0"), (0, "MPL-2.0"), (1, "CC-BY-4.0")]


def test_many_wordings_in_one_text():
    """800 notices in a line, or in a line each, and a long text of all wordings: each is found, in time that grows in proportion."""
    scanner, notice = license.Scanner(), "Licensed under the MIT License."
    for glue in (" ", "\n"):
        took = []
        for n in (200, 800):
            begin = time.process_time()
            got = scanner.scan(glue.join([notice] * n))
            took.append(time.process_time() - begin)
            assert [(g[0], g[2], g[5] + g[6]) for g in got] == [(i * (len(notice) + 1), "MIT", 0) for i in range(n)]
        assert took[1] < 10 * took[0] + 0.5
    filler = " ".join(f"filler{i}" for i in range(3000))
    many = [t for _, t in license.TEMPLATES] * 3
    got = scanner.scan(filler + "\n" + "\n\n".join(many) + "\n" + filler)
    assert [g[3] for g in got] == list(range(len(license.TEMPLATES))) * 3 and all(g[5] + g[6] == 0 for g in got)


def test_confirm_against_edit_scripts():
    """Wordings with random edits among other words, against the longest common subsequence in every window."""
    import random

    def common(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(row[j] + 1 if w == v else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    rng, scanner = random.Random(7), license.Scanner()
    for _ in range(60):
        i = rng.randrange(len(license.TEMPLATES))
        want = scanner.templates[i][2]
        mine = [w if rng.random() > 0.08 else f"other{rng.random()}" for w in want]
        have = [*(f"a{j}" for j in range(rng.randrange(9))), *mine, *(f"b{j}" for j in range(rng.randrange(9)))]
        width = len(want) + int(license.MAX_EXTRA * len(want))
        most = max(common(have[p:p + width], want) for p in range(max(1, len(have) - width + 1)))
        got = scanner.confirm(have, i)
        assert all(len(want) - m <= most for _, _, m, _ in got)
        assert bool(got) == (most >= license.MIN_SHARE * len(want))


def test_odd_documents_with_wordings(spark):
    long = "word " * 60_000
    rows = [(None, f"{long}Licensed under CC BY 4.0. {long}"), (1, "SPDX-License-Identifier: MIT"), (1, "SPDX-License-Identifier: MIT"), (2, None), (3, "")]
    got = license.scan_licenses(spark.createDataFrame([(*r, "l", 1) for r in rows], "doc_id long, text string, license string, start int"))
    assert sorted((r.doc_id or 0, r.license, r.exact) for r in got.collect()) == [(0, "CC-BY-4.0", True), (1, "MIT", True), (1, "MIT", True)]
