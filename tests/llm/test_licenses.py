import math
import re
import textwrap
from collections import Counter

import pytest

from vaultspark.llm import licenses


def test_anchors_lose_no_line():
    """Without anchors, no template can be reached: what is left of it is shorter than the threshold."""
    anchors = set(licenses.anchors())
    assert not anchors & {"the", "a", "of", "and", "to", "in"}  # words of every text
    for name in {r[0] for r in licenses.weights()[2] if r[0].endswith("u")}:
        assert math.sqrt(sum(w * w for n, t, w in licenses.weights()[2] if n == name and t not in anchors)) < licenses.THRESHOLD


def brute(line, kinds="u"):
    idf, other, rows = licenses.weights()
    c = Counter(re.findall(licenses.TOKEN, line.lower()))
    norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in c.items()))
    best = None
    for name in sorted({r[0] for r in rows if r[0][-1] in kinds}):
        s = round(sum(c[t] * idf[t] * w for n, t, w in rows if n == name) / norm, 6) if norm else 0
        if s >= licenses.THRESHOLD and (best is None or (-s, name.split("#")[0]) < best):
            best = (-s, name.split("#")[0])
    return best and best[1]


def test_scan_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("LICENSE", mit), ("a/x.py", "code\nmore"), ("a/b/LICENSE.txt", gpl), ("a/b/c/d.py", None), ("a/b/c/e.py", f"# {mit}\ncode"), ("z.txt", ""), ("a/b/COPYING", "nothing here"), (None, mit), ("z.txt", ""), ("q/long", "the and " * 50_000)]
    df = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, id string")
    got = {r.path: r for r in licenses.scan(df).collect()}
    assert set(got) == {p for p, _ in files if p}
    assert {p: r.licence for p, r in got.items()} == {"LICENSE": "mit", "a/x.py": "mit", "a/b/LICENSE.txt": "gpl-3.0", "a/b/c/d.py": "gpl-3.0", "a/b/c/e.py": "mit", "z.txt": "mit", "a/b/COPYING": "gpl-3.0", "q/long": "mit"}
    assert got["a/b/c/d.py"].inherited_from == "a/b" and got["a/b/c/e.py"].inherited_from is None and got["z.txt"].inherited_from == ""
    assert licenses.scan(df.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    lines = [t for _, t in licenses.TEMPLATES] + ["// Licensed under CC BY 4.0!", "licensed under the apache license version 1", "mit", "The licence of this work", "Licensed under CC BY-NC 4.0. And much else besides that is not of any licence at all", ""]
    df = spark.createDataFrame([(f"f{i:03}", t) for i, t in enumerate(lines)], "path string, text string")
    got = {r.path: r.own_licence for r in licenses.scan(df).collect()}
    assert got == {f"f{i:03}": brute(t) for i, t in enumerate(lines)}


def wrapped(text, mark="", width=70):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def paragraphs(name, where=licenses.TEMPLATES):
    return [t for n, t in where if n == name]


HEADS = {
    "gpl-3.0": [t for t in paragraphs("gpl-3.0") if "either version" in t],
    "gpl-2.0": [t for t in paragraphs("gpl-2.0") if "either version" in t],
    "lgpl-2.1": [t for t in paragraphs("lgpl-2.1") if "either version" in t],
    "agpl-3.0": [t for t in paragraphs("agpl-3.0") if "either version" in t],
    "apache-2.0": [t for t in paragraphs("apache-2.0") if "obtain a copy" in t],
    "mpl-2.0": [t for t in paragraphs("mpl-2.0") if "If a copy" in t],
    "mit": [t for t in paragraphs("mit") if "subject to the following" in t],
    "isc": paragraphs("isc")[:1],
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
def test_wrapped_headers_are_seen_whole(spark, mark):
    rest = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the license for more details."
    files = [(name, f"{mark}Copyright (C) 2020 Some One\n{wrapped(heads[0], mark)}\n{mark.rstrip()}\n{wrapped(rest, mark)}\n\nimport os\n") for name, heads in HEADS.items()]
    got = {r.path: (r.own_licence, r.own_unit) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {name: (name, "block") for name in HEADS}


def test_whole_licence_files_decide_for_their_directory(spark):
    files = []
    for name in ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense"):
        (text,) = paragraphs(name, licenses.WHOLE)
        files += [(f"{name}/LICENSE", "Copyright (c) 2020 Some One\n\n" + wrapped(text, "", 80)), (f"{name}/src/x.c", "int x;")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for path, r in got.items():
        assert r.licence == path.split("/")[0]
        assert (r.own_unit, r.inherited_from) == (("whole", None) if path.endswith("LICENSE") and r.own_unit == "whole" else (r.own_unit, r.inherited_from))
    assert got["mit/src/x.c"].inherited_from == "mit" and got["bsd-2-clause/LICENSE"].own_unit == "whole"


@pytest.mark.parametrize("line,want", [("// SPDX-License-Identifier: MIT", "mit"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd-3-clause"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"), ("SPDX-License-Identifier: AGPL-3.0", "agpl-3.0"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa-4.0")])
def test_spdx_lines(spark, line, want):
    assert licenses.scan(spark.createDataFrame([("f", f"x\n{line}\ny")], "path string, text string")).first().own_licence == want


def test_last_line_tells_licence_files(spark):
    files = [("d/1", "text\nReleased under the MIT License."), ("d/2", "Released under the MIT License.\ntext"), ("e/1", "Licensed under CC BY 4.0.\ntext"), ("e/2", "x"), ("d/3", "y")]
    got = {r.path: (r.licence, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "path string, text string"), licence_file=licenses.LAST_LINE).collect()}
    assert got == {"d/1": ("mit", None), "d/2": ("mit", None), "e/1": ("cc-by-4.0", None), "e/2": (None, None), "d/3": ("mit", "d")}


def test_ties_between_templates_go_to_the_first_name(spark):
    both = "Licensed under CC BY 4.0. CC BY-SA"
    df = spark.createDataFrame([("a", both + "\n" + both, 1, 2), ("b", None, 1, 2)], "path string, text string, unit int, body int")
    r = {x.path: x for x in licenses.scan(df).collect()}
    assert (r["a"].own_line, r["a"].own_unit, r["a"].own_licence) == (0, "line", brute(both)) and r["b"].own_licence is None


def test_units_out_of_reach_are_left_out_before_terms_are_exploded(spark):
    """An anchor among other words is no candidate; whatever a template reaches is one, with other words and repeats around it."""
    texts = ["The license of this code is another matter, as our neighbours often say over lunch", "license " + "other words around " * 9]
    near = [t + " word" * n + f" {pad}" * m for _, t in licenses.TEMPLATES[::3] + licenses.WHOLE for n in (0, 1, 2, 5) for m, pad in ((0, ""), (3, "the"), (40_000, "license"))]
    rows = [(f"{i:04}", t, False) for i, t in enumerate(texts + near)]
    got = {r.id for r in licenses._units(spark.createDataFrame(rows, "id string, body string, is_file boolean"), licenses.THRESHOLD).select("id").collect()}
    reached = {i for i, t, _ in rows if brute(t, "uw")}
    assert not got & {"0000", "0001"} and len(reached) > 30
    assert {i for i in reached if brute(rows[int(i)][1])} <= got
