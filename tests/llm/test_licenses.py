"""The licence scan on licences as they are published: wrapped at many widths, both spellings, bullets, notices of all kinds."""

import os
import re
import textwrap

import pytest

from netlex.llm import licenses

COMMON = "/usr/share/common-licenses"
KNOWN = dict(licenses.KNOWN[::-1])


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license_id string, found int")
    return {r.doc_id: r.license_id for r in licenses.scan(docs).collect()}


def wrapped(text, width):
    """Paragraphs wrapped anew, but those with notices or lists on lines of their own."""
    own_lines = r"(?i)^\s*copyright|\n\s*copyright|\n\s*\(?\w{1,4}[.)]\s"
    return "\n\n".join(p if re.search(own_lines, p) else "\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in re.split(r"\n\s*\n", text))


def test_published_forms(spark):
    bsd = KNOWN["BSD-3-Clause"]
    bullets = re.sub(r"(?m)^[123]\. ", "* ", bsd)
    owner = bsd.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")
    heads = ["", "Copyright (c) 2019, A. Person\nAll rights reserved.\n\n", "Copyright Jane Doe\n\n", "\n\nCopyright Jane Doe and others\nCopyright J. Roe\n\n", "Copyright © 2001-2020 The Project Authors.\n\n"]
    rows, want = [], {}
    for base, name in [(bsd, "BSD-3-Clause"), (bullets, "BSD-3-Clause"), (owner, "BSD-3-Clause"), (KNOWN["MIT"], "MIT"), (KNOWN["ISC"], "ISC"), (KNOWN["Unlicense"], "Unlicense")]:
        lines = base.split("\n")
        for head in heads:
            for width in (60, 67, 72, 79, 80, 99):
                text = head + "\n".join("\n".join(textwrap.wrap(x, width)) for x in lines)
                for form in (text, text.replace("\n", "\r\n"), text.replace("license", "licence"), text.replace("sublicense", "sub-license"), text.replace("sublicense", "sub\nlicense")):
                    want[len(rows)] = name
                    rows.append((len(rows), form))
    got = scan(spark, rows)
    assert {i: (got[i], n, rows[i][1]) for i, n in want.items() if got[i] != n} == {}


def test_what_is_no_licence(spark):
    mit = KNOWN["MIT"]
    texts = [mit[:-40], mit.replace("without restriction", "with restriction"), "Copyright Jane Doe", "", None, "copyright holders be liable\n\ncopyright notice", mit + mit]
    assert set(scan(spark, list(enumerate(texts))).values()) == {None}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no public licence texts here")
def test_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "BSD": "BSD-3-Clause"}
    rows, want = [], {}
    for file, name in names.items():
        with open(f"{COMMON}/{file}", encoding="utf-8") as f:
            text = f.read()
        for form in (text, text.upper(), re.sub(r"(?m)^[ \t]+", "", text), wrapped(text, 70), text.replace("license", "licence"), "\n\n" + text.replace("\n", "\r\n")):
            want[len(rows)] = name
            rows.append((len(rows), form))
    got = scan(spark, rows)
    assert {i: (got[i], n) for i, n in want.items() if got[i] != n} == {}
