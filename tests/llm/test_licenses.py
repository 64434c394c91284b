from folioflow.llm import licenses as li


def test_own_inherited_none(spark):
    mit, apache = "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/f.txt", "no notice"),
        (3, "a/b/COPYING.txt", apache),
        (4, "a/b/g.txt", None),
        (5, "a/b/h.txt", "word " * 20000 + "\n" + mit),
        (6, "ab/f.txt", ""),
        (7, None, "z"),
        (8, "a/f.txt", "a licensed thing of quite another kind with many other words in it"),
        (8, "a/f.txt", "a licensed thing of quite another kind with many other words in it"),
        (None, "a/b/n.txt", "q"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS h", "'k' AS license", "2 AS d", "3 AS dir")
    t = spark.createDataFrame(li.TEMPLATES, "license string, text string")
    got = sorted(((r.doc_id, r.license, r.origin) for r in li.scan(files, t).collect()), key=str)
    want = [(1, "MIT", "own"), (2, "Apache-2.0", "inherited"), (3, "Apache-2.0", "own"), (4, "Apache-2.0", "inherited"), (5, "MIT", "own"), (6, None, "none"), (7, None, "none"), (8, "MIT", "inherited"), (8, "MIT", "inherited"), (None, "Apache-2.0", "inherited")]
    assert got == sorted(want, key=str)
    assert li.scan(files.limit(0), t).count() == 0
    assert {r.origin for r in li.scan(files, t.limit(0)).collect()} == {"none"}


def test_tags_headers_bodies_and_windows(spark):
    apache, mit, bsd = (dict((a, t) for a, t in li.TEXTS)[k] for k in ("Apache-2.0", "MIT", "BSD-3-Clause"))
    wrapped = lambda t: "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    cases = [
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("// SPDX-License-Identifier: (GPL-2.0-or-later OR Foo-1.0)\ncode", "GPL-2.0"),
        ("SPDX-License-Identifier: MIT-0", None),
        ("SPDX-License-Identifier: Unknown-1.0", None),
        ("Copyright (c) 2024 Ann Example. Released under the MIT License. See the file for details of it", "MIT"),
        ("many words of a paragraph go before it. Licensed under the Apache License, Version 2.0. And many more words come after it here", "Apache-2.0"),
        ("BSD 3-Clause License", "BSD-3-Clause"),
        ("Mozilla Public License Version 2.0", "MPL-2.0"),
        ("Another Public License Version 2.0", None),
        (wrapped(apache) + "\n\ncode " * 300, "Apache-2.0"),
        ("word " * 500 + "\n" + wrapped(bsd) + "\n" + "word " * 500, "BSD-3-Clause"),
        ("plain prose about nothing", None),
    ]
    rows = [(i, f"d{i}/f.txt", t) for i, (t, _) in enumerate(cases)] + [(90, "m/LICENSE", mit.split("THE SOFTWARE IS")[0]), (91, "m/x/f.txt", "z"), (92, "e/LICENSE", "nothing of the kind")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    t = spark.createDataFrame(li.TEMPLATES + li.TEXTS, "license string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in li.scan(files, t, names=li.NAMES).collect()}
    want = {i: (x, "own" if x else "none") for i, (_, x) in enumerate(cases)} | {90: ("MIT", "own"), 91: ("MIT", "inherited"), 92: (None, "none")}
    assert got == want
