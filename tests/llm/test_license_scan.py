"""Licence scans: notices, licence files and inheritance by directory."""

from __future__ import annotations

import textwrap

from rosterlake.llm import license_scan, license_texts


def test_notices_and_inheritance(spark):
    prose = "Some words of a text that says nothing of the kind. " * 5
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", prose),
            (3, "a/b/y.txt", prose + "\nLicensed under the Apache License, Version 2.0."),
            (4, "z/x.txt", prose), (5, None, None), (6, "a/b/c/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (7, "a/b/c/d/e/t.txt", ""), (8, "z/w.txt", "He got a license. " + prose)]
    got = {r.file_id: (r.own, r.is_license_file, r.license) for r in license_scan.scan(
        spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", True, "MIT"), 2: (None, False, "MIT"), 3: ("Apache-2.0", False, "Apache-2.0"), 4: (None, False, None),
                   5: (None, False, None), 6: ("GPL-3.0", True, "GPL-3.0"), 7: (None, False, "GPL-3.0"), 8: (None, False, None)}
    assert license_scan.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_notices_in_other_words(spark):
    want = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "// SPDX-License-Identifier: MIT": "MIT", "MIT License": "MIT", "Licensed under the MIT license": "MIT",
            "License: CC-BY-SA-3.0": "CC-BY-SA-3.0", "Available under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported Licence": "CC-BY-NC-SA-3.0",
            "Simplified BSD Licence": "BSD-2-Clause", "Distributed under the 3-clause BSD license": "BSD-3-Clause", "This package is GPLv3 licensed": "GPL-3.0",
            "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "We publish it under the GNU Affero General Public License v3.0": "AGPL-3.0",
            "This code is licensed under Apache 2.0": "Apache-2.0", "https://creativecommons.org/licenses/by-nd/4.0/": "CC-BY-ND-4.0",
            "Licensed under the GNU GPL": "GPL", "This document is under the Foo Widget Licence": None, "He got a driving licence at last": None,
            "Use of this work under the license of the author": None, "with permission of the board": None}
    prose = "\n" + "Some words of a text that says nothing of the kind. " * 5
    rows = [(k, f"d{k}/x", t + prose) for k, t in enumerate(want)]
    got = license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()
    assert {rows[r.file_id][2].removesuffix(prose): r.license for r in got} == want


def test_headers_and_whole_texts(spark):
    texts = dict(license_texts.full_texts())
    prose = "def f(x):\n    return x + 1  # some words of code that say nothing of the kind at all\n\n" * 12
    gpl = """# This file is part of Thing.
#
# Thing is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# Thing is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
    apache = """/*
 * Copyright 2020 The Thing Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
"""
    wrap = textwrap.fill
    owner = "Copyright (c) 2020 A Person Of That Name <person@example.org>\nAll rights reserved.\n\n"
    agpl, mit = texts["AGPL-3.0"], texts["MIT"]
    want = {"m/LICENSE": (owner + wrap(mit, 78), "MIT", True), "n/LICENSE": (owner + mit, "MIT", True),     # wrapped, and as one long line
            "o/x.txt": (texts["Apache-2.0"], "Apache-2.0", True), "g/COPYING": (texts["GPL-3.0"], "GPL-3.0", True), "h/c": (texts["GPL-2.0"], "GPL-2.0", True),
            "l/c": (texts["LGPL-2.1"], "LGPL-2.1", True), "af/c": (agpl, "AGPL-3.0", True), "p/c": (texts["MPL-2.0"], "MPL-2.0", True),
            "b2/LICENSE": (owner + wrap(texts["BSD-2-Clause"], 70), "BSD-2-Clause", True), "b3/LICENSE": (owner + wrap(texts["BSD-3-Clause"], 70), "BSD-3-Clause", True),
            "src/a.py": (gpl + prose, "GPL-3.0", False), "src/b.c": (apache + prose, "Apache-2.0", False),
            "src/e.c": ("\n".join("// " + x if x else "//" for x in wrap(texts["BSD-2-Clause"], 70).splitlines()) + "\n\n" + prose, "BSD-2-Clause", False),
            "src/c.py": (prose + "\n\n" + mit + "\n\n" + prose, "MIT", False), "src/d.py": (prose, None, False),
            "m/LICENSE.md.d/deep/z.py": (prose, "MIT", False), "q/license.py": (prose + "\n# SPDX-License-Identifier: ISC\n", "ISC", False)}
    rows = [(k, path, text) for k, (path, (text, _, _)) in enumerate(want.items())]
    got = {rows[r.file_id][1]: (r.license, r.is_license_file) for r in license_scan.scan(
        spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {path: tuple(v[1:]) for path, v in want.items()}
