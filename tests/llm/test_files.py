import random
import re

import pytest

from siltstone.llm import codefiles as G
from siltstone.llm import license as L
from siltstone.llm import license_texts as T

REFERENCE = [("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("GPL-2.0-only", "GNU General Public License v2.0 only"), ("GPL-3.0-only", "GNU General Public License v3.0 only"), ("GPL-3.0-or-later", "GNU General Public License v3.0 or later"), ("LGPL-3.0-only", "GNU Lesser General Public License v3.0 only"), ("AGPL-3.0-only", "GNU Affero General Public License v3.0 only"), ("Unlicense", "The Unlicense"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("Zlib", "zlib License")]


@pytest.fixture(scope="module")
def model():
    return L.LicenseModel(sorted(REFERENCE))


@pytest.mark.parametrize("phrase,want", [
    ("mit", "MIT"), ("The MIT licence", "MIT"), ("Expat", "MIT"), ("GPLv3+", "GPL-3.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("gpl 2", "GPL-2.0-only"), ("GNU GPL version 3 or any later version", "GPL-3.0-or-later"),
    ("Apache License, Version 2.0", "Apache-2.0"), ("three-clause BSD", "BSD-3-Clause"), ("Creative Commons Attribution 4.0", "CC-BY-4.0"), ("LGPLv3 only", "LGPL-3.0-only"),
    ("GPL-2.0-or-later", "UNKNOWN"), ("Apache 1.1", "UNKNOWN"), ("CC-BY-SA-4.0", "UNKNOWN"), ("LicenseRef-House-Terms", "UNKNOWN"), ("Grolvard Evaluation Licence 3", "UNKNOWN"), ("BSD 4-clause", "UNKNOWN"), ("", "UNKNOWN"),
])
def test_names(model, phrase, want):
    assert model.predict(phrase) == want


def test_held_out_spellings(model):
    r = random.Random(0)
    hit = n = 0
    for phrase, label in L.training_phrases(sorted(REFERENCE)):
        for form in (phrase.upper(), f"  the {phrase} licence.", phrase.replace(" ", "-") if r.random() < 0.5 else phrase.title()):
            n += 1
            hit += model.predict(form) == (label if label != L.OTHER else "UNKNOWN")
    assert hit / n >= 0.97


@pytest.mark.parametrize("text,prose,want", [
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode()", False, [["MIT", "Apache-2.0"]]),
    ("/*\n * You may copy this source under the\n * conditions of MIT License;\n */", False, [["MIT License"]]),
    ("let s = \"License: MIT\";", False, []),
    ("# Copyright 2020 people\ndef f(): pass", False, []),
    ("---\ntitle: x\nlicense: mit/Apache-2.0\n---\ntext", True, [["mit", "Apache-2.0"]]),
    ("The checker refuses MIT plugins unless x is on.\n", True, []),
    ("## License\n\nReleased under Mozilla Public License, v. 2.0.\n", True, [["Mozilla Public License, v. 2.0"]]),
    ("License: see LICENSE\n", True, []),
])
def test_statements(text, prose, want):
    assert L.own_statements(text, prose) == want


class Held:
    value = (L.LicenseModel(sorted(REFERENCE)), T.TextModel(sorted(x for x, _ in REFERENCE)))


GPL = """{0} This file is part of Thing. Thing is free software: you can redistribute it and/or modify
{0} it under the terms of the GNU General Public License as published by
{0} the Free Software Foundation, either version {1} of the License, or
{0} (at your option) any later version.
{0}
{0} Thing is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
{0} implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
"""
MIT_TEXT = "Copyright (c) 2020 Some Body\n\n" + "\n\n".join(T._MIT)


@pytest.mark.parametrize("path,text,want", [
    ("a.py", GPL.format("#", 3) + "go()", "GPL-3.0-or-later"), ("a.py", GPL.format("#", 2) + "go()", "UNKNOWN"), ("a.c", "/*\n" + GPL.format(" *", 3) + " */\ngo();", "GPL-3.0-or-later"),
    ("a.ts", "/*\n" + MIT_TEXT + "\n*/\ngo();", "MIT"), ("README.md", "# Thing\n\nIt works.\n\n## License\n\n" + MIT_TEXT + "\n", "MIT"), ("a.ts", "const t = `" + T._MIT[0] + "`;", None),
    ("LICENSE", MIT_TEXT, "MIT"), ("LICENSE", T._ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.", "ISC"), ("LICENSE", T._ISC_GRANT + ".\n\n" + T._ISC_WARRANTY, "UNKNOWN"),
    ("COPYING", "House Terms 9\n\nYou may look at this software but permission to copy it is not given to anyone here at all.", "UNKNOWN"),
    ("a.rs", "// This function takes permission flags of the software and returns the rights of each person to use the given files.\ngo();", None),
    ("a.js", "// SPDX-License-Identifier: MIT AND Apache-2.0\n", "Apache-2.0 AND MIT"), ("a.js", "// SPDX-License-Identifier: GPL-3.0-only WITH Classpath-exception-2.0\n", "GPL-3.0-only"), ("a.js", "// License: BSD\n", "UNKNOWN"), ("a.js", "// SPDX-License-Identifier: MIT AND Weird-1 OR ISC\n", "ISC"),
])
def test_texts_and_expressions(path, text, want):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["v"]), pa.array([path]), pa.array([text.encode()])], names=["scope", "path", "content"])
    got = [L.value_of(r["names"], Held.value[0].predict) for b in L._read_files(Held)(iter([batch])) for r in b.to_pylist()]
    assert got == ([want] if want else [])


def test_every_training_text_passes_the_filter_and_is_told():
    known = {x for x, _ in REFERENCE}
    for text, label in T.training_rows(known):
        assert L._HINT.search(text.encode())
        assert Held.value[1].predict(text) == label


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, source_version_id string, source_path string, license array<string>, names int, scope int")


def test_reconciliation(spark):
    f = [("v", "LICENSE-MIT", b"MIT License\n"), ("v", "LICENSE-APACHE", b"Apache License, Version 2.0\n"), ("v", "a/package.json", b'{"license": "ISC"}'), ("v", "a/x.ts", b"// SPDX-License-Identifier: MPL-2.0\n"), ("v", "a/y.ts", b"go()"), ("v", "b/z.md", b"\xff\xfetext"), ("v", "c/COPYING", b"Weird House Terms 9\n"), ("v", "c/q.py", b"# License: MIT\n"), ("w", "n.md", None), ("v", "NOTICE", b"MIT License")]
    files = spark.createDataFrame(f, "source_version_id string, path string, content binary")
    d = docs(spark, [("1", "v", "./a\\x.ts", None, 0, 0), ("2", "v", "a/y.ts", ["NOASSERTION"], 0, 0), ("3", "v", "b/z.md", [], 0, 0), ("4", "v", "c/r.py", None, 0, 0), ("5", "v", "c/q.py", ["Apache-2.0"], 0, 0), ("6", "w", "n.md", None, 0, 0), ("7", "v", "c/q.py", ["the MIT license", ""], 0, 0), ("8", None, None, None, 0, 0), ("2", "v", "a/y.ts", ["NOASSERTION"], 0, 0)])
    versions = spark.createDataFrame([("v", "s", True), ("w", "t", True), ("x", "s", False)], "id string, source_id string, is_active boolean")
    sources = spark.createDataFrame([("s", ["MIT or Apache-2.0"]), ("t", None), ("u", ["GPL-3.0+"])], "id string, license array<string>")
    ref = spark.createDataFrame(REFERENCE, "spdx_id string, title string")
    got = {(r.unit_kind, r.unit_id): r.license for r in L.resolve_licenses(d, files, versions, sources, ref).collect()}
    both = "Apache-2.0 OR MIT"
    assert got == {("file", "1"): "MPL-2.0", ("file", "2"): "ISC", ("file", "3"): both, ("file", "4"): "UNKNOWN", ("file", "5"): "CONFLICT", ("file", "6"): "NONE", ("file", "7"): "MIT", ("file", "8"): "NONE", ("repository", "s"): both, ("repository", "t"): "NONE", ("repository", "u"): "GPL-3.0-or-later"}
    empty = L.resolve_licenses(d.where("1 = 0"), files.where("1 = 0"), versions.where("1 = 0"), sources.where("1 = 0"), ref)
    assert empty.count() == 0


@pytest.mark.parametrize("line,want", [
    ("Distributed under MIT.", ["MIT"]), ("Available under Apache-2.0.", ["Apache-2.0"]), ("Offered under MIT or ISC.", ["MIT", "ISC"]), ("Published under MPL 2.0.", ["MPL 2.0"]), ("Released by MIT.", ["MIT"]), ("All code here is distributed by ISC.", ["ISC"]),
    ("Use it on the terms of MIT.", ["MIT"]), ("Copy it under the conditions of MIT.", ["MIT"]), ("Nothing said.", None),
])
def test_every_notice_passes_the_filter(line, want):
    import pyarrow as pa

    for path, text in (("README.md", line), ("a.rs", f"// {line}\ncode()")):
        batch = pa.RecordBatch.from_arrays([pa.array(["v"]), pa.array([path]), pa.array([text.encode()])], names=["scope", "path", "content"])
        got = [r for b in L._read_files(Held)(iter([batch])) for r in b.to_pylist()]
        assert [r["names"] for r in got] == ([want] if want else [])


BODY = "export function go(a: number) {\n  const b = calc(a, 12);\n  if (b > 3) { return stop; }\n  log(\"one\", b);\n  other.push(b);\n}\n"


@pytest.mark.parametrize("text,want", [
    (BODY, None),
    ("const x = ['@generated', 'DO NOT EDIT'];\n" + BODY, None),
    ("// First generated by x in 2020, kept up by hand since.\n" + BODY, None),
    ("// @generated by x\n" + "".join(f'export const a{k} = field({k}, "n{k}", {k * 7});\n' for k in range(30)), "generated"),
    ("".join(f'export const a{k} = field({k}, "n{k}", {k * 7});\n' for k in range(30)), "generated"),
    (";".join(f"function f{k}(a,b){{return a.c?b[{k}]:a(b,{k})}}" for k in range(40)), "minified"),
    ("const t = [\n" + ",\n".join(", ".join(str(k * 37 % 991) for k in range(r, r + 12)) for r in range(30)) + "\n];", "data"),
    ("// Vendored from upstream thing 2.1.0, local changes: none.\n" + BODY, "third_party"),
    ("// Used to be vendored; rewritten from scratch.\n" + BODY, None),
    ("", None),
    ("x" * 200_000, None),
])
def test_verdicts(text, want):
    assert G.judge(text, "ts") == want


VARIED = "".join(f"export type T{k} = {{ a: number }};\n\nexport function read{k}(x: string) {{\n  const y = parse(x, {k});\n  if (y) {{\n    send(y);\n  }}\n}}\n" for k in range(9))
MIXED = "".join(f"const a{k} = one({k});\nconst b{k} = one({k});\nlet c{k};\n" for k in range(20))


@pytest.mark.parametrize("text,extension,want", [
    ("// Code generated by maker. DO NOT EDIT.\n\n" + VARIED, "ts", "generated"),
    (VARIED, "ts", None),
    (MIXED, "ts", "generated"),
    (re.sub(r"(a\d+) = ", r"\1=", MIXED), "ts", None),
    ("".join(f"def f{k}(a,b):\n c=a+b\n if c==b:return a-c\n return c\n" for k in range(20)), "py", "minified"),
    ("".join(f"def f{k}(a, b):\n    c = a + b\n    if c == b:\n        return a - c\n    return c\n" for k in range(20)), "py", None),
    (",".join(f"a{k}=go(b{k},c)" for k in range(90)), "js", "minified"),
    ("const t=[" + ",".join(f'{{"id":{k},"w":"{k * 7919}"}}' for k in range(200)) + "];", "js", "data"),
])
def test_verdicts_by_layout(text, extension, want):
    assert G.judge(text, extension) == want


NAMES = "Alpha Beta Gamma Delta Eps Zeta Eta Theta Iota Kappa Lam Mu".split()


@pytest.mark.parametrize("text,extension,want", [
    ("".join(f"import {{ {n} }} from './{n.lower()}';\n" for n in NAMES), "ts", None),
    ("".join(f"export * from './{n.lower()}';\n" for n in NAMES), "ts", None),
    ("".join(f"pub use self::{n.lower()}::{n};\n" for n in NAMES), "rs", None),
    ("export enum Kind {\n" + "".join(f"  {n} = '{n.lower()}',\n" for n in NAMES) + "}\n", "ts", None),
    (".a { color: red; }\n.b { margin: 0; padding: 1px; }\n.c { display: none; }\n.d { color: blue; }\n.e { width: 1px; }\n", "css", None),
    ("export function add(a: number, b: number): number { const c = a + b; log(c); return c; }\n", "ts", None),
    ("const a = one(1);\nconst b = one(2);\nconst c = one(3);\nconst d = one(4);\n", "ts", None),
    ("// Copied verbatim out of the meridian project, release 2.1\n" + BODY, "ts", "third_party"),
    ("// Copied from the tests on the next page by hand.\n" + BODY, "ts", None),
])
def test_hand_written_files_of_one_kind(text, extension, want):
    assert G.judge(text, extension) == want


@pytest.mark.parametrize("head,extension", [
    ("// Copyright line\n" * 60 + "// {}", "ts"), ("# Copyright line\n" * 60 + "# {}", "py"), ("#!/usr/bin/env node\n// {}", "js"), ("<?php\n// {}", "php"), ("<?php\n# {}", "php"), ("-- {}", "sql"), ("/* {} */", "sql"),
    ("--[[\n{}\n]]", "lua"), ("-- {}", "lua"), ("{{- {} -}}", "hs"), ("-- {}", "hs"), ("%% {}", "erl"), ("(* {} *)", "ml"), ("<!-- {} -->", "vue"), ("<script lang='ts'>\n// {}", "svelte"), ("#= {} =#", "jl"), ("#[ {} ]#", "nim"), ("=begin\n{}\n=end", "rb"), ("/* {} */", "css"),
])
def test_markers_in_the_comments_before_the_code(head, extension):
    assert G.judge(head.format("Code generated by maker. DO NOT EDIT.") + "\n" + BODY, extension) == "generated"
    assert G.judge(head.format("Vendored from upstream thing 2.1.0.") + "\n" + BODY, extension) == "third_party"
    assert G.judge(head.format("Kept by hand.") + "\n" + BODY, extension) is None
    assert G.judge("go(1)\n" + head.format("Code generated by maker. DO NOT EDIT.") + "\n" + BODY, extension) is None


def test_an_attribute_is_no_shebang():
    assert G.layout("#![allow(dead_code)]\ngo();\n", "rs")["lines"] == 2


@pytest.mark.parametrize("text,extension", [
    ("fn go(a: u32) -> u32 {\n    let b = a + 1;\n    if b == 3 {\n        return b;\n    } else {\n        stop();\n    }\n    b - 1\n}\n", "rs"),
    ("call(\n  " + ",\n  ".join(f"other(name{k}, {k})" for k in range(12)) + "\n);\nnext(1, 2);\n", "ts"),
])
def test_canonical_layout_agrees_and_changes_of_it_do_not(text, extension):
    assert G.layout(text, extension)["agreement"] == 1
    for was, now in ((" = ", "="), (", ", ","), ("\n    ", "\n      "), ("\n  other", " other"), ("{\n", "{ ")):
        if was in text:
            assert G.layout(text.replace(was, now), extension)["agreement"] < 1


def test_files_by_path_and_copies(spark):
    body = BODY.encode()
    files = spark.createDataFrame([("v", "src/a.ts", body), ("v", "vendor/p/a.ts", body), ("v", "src/b.ts", body + b"//"), ("v", "vendoring/c.ts", b"go();\nstop(1);\n"), ("v", "deps/e.ts", b""), ("v", "src/e.ts", b""), ("v", "third_party/readme.md", b"x"), ("v", "n.ts", None)], "source_version_id string, path string, content binary")
    d = spark.createDataFrame([("1", "v", "./src/a.ts", 0), ("2", "v", "vendor\\p\\a.ts", 0), ("3", "v", "src/b.ts", 0), ("4", "v", "vendoring/c.ts", 0), ("5", "v", "deps/e.ts", 0), ("6", "v", "src/e.ts", 0), ("7", "v", "third_party/readme.md", 0), ("8", "v", "node_modules/gone.js", 0), ("9", "v", None, 0), (None, "v", "vendor/p/a.ts", 0), ("1", "v", "./src/a.ts", 0), ("10", "v", "n.ts", 0)], "id string, source_version_id string, source_path string, verdict int")
    got = {r.id: r.verdict for r in G.not_handwritten(d, files).collect()}
    assert got == {"1": "third_party", "2": "third_party", "5": "third_party", "8": "third_party"}
    assert G.not_handwritten(d.where("1 = 0"), files.where("1 = 0")).count() == 0
