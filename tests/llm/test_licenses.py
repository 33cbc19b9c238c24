"""License scan: every notice of a text, however the lines run."""

import pytest

from lodestream.llm import license_scan as L


def found(text):
    return [p[2:4] for p in L.passages(text)]


def test_every_notice_of_a_line():
    both = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert found(both) == [("Apache-2.0", "exact"), ("MIT", "exact")]
    assert [both[s : s + n] for s, n, *_ in L.passages(both)] == ["Licensed under the Apache License, Version 2.0", "Released under the MIT License"]
    long = "word " * 300 + " ".join(L.TEMPLATES.values()) + " word" * 300
    assert found(long) == [(name, "exact") for name in L.TEMPLATES]
    assert found("Released under the MIT License. " * 50) == [("MIT", "exact")] * 50


def test_notice_over_several_lines():
    assert found("x\n// Licensed under the Apache\n// License, Version 2.0.\ny") == [("Apache-2.0", "exact")]


@pytest.mark.parametrize("form", range(len(L.TEMPLATES)))
def test_alignment_is_the_least_difference(form):
    """Against the least number of words dropped and added of all passages, by the common subsequence."""
    number, forms, _, _ = L._index()
    name, text = list(L.TEMPLATES.items())[form]
    words = [number[w.lower()] for w in L._WORD.findall(text)]
    for drop in range(len(words)):
        shown = [-1, *words[:drop], *words[drop + 1 :][:2], -1, *words[drop + 1 :][2:], -1]

        def cost(a, b, shown=shown):
            row = [0] * (b - a + 1)
            for w in words:
                row, last = [0] * (b - a + 1), row
                for j in range(b - a):
                    row[j + 1] = last[j] + 1 if shown[a + j] == w else max(row[j], last[j + 1])
            return len(words) + b - a - 2 * row[-1]

        f = L.FORMS.index((name, text))
        least = min(cost(a, b) for a in range(len(shown)) for b in range(a + 1, len(shown) + 1))
        got = forms[f].align(shown)
        assert all(c == cost(a, b) for a, b, c in got)
        assert min((c for *_, c in got), default=None) == (least if least <= forms[f].most else None)


def full(name):
    from lodestream.llm import license_forms

    return license_forms._text(name)


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "Unlicense"])
def test_full_text(name):
    lines = "\n".join(f" * {line}" for line in full(name).splitlines())
    for text in (full(name), "Some words before.\n" + lines + "\nand after", " ".join(full(name).split())):
        assert found(text) == [(name, "exact")]
    words = full(name).split()
    altered = " ".join(w for i, w in enumerate(words) if i % 20 != 7)
    assert found(altered) == [(name, "altered")]


def test_kin_of_full_texts():
    two = full("BSD-3-Clause").replace("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n", "")
    assert found("Copyright (c) 2020, A. All rights reserved.\n" + two) == [("Reserved", "exact"), ("BSD-2-Clause", "exact")]
    assert found(full("MIT") + full("ISC")) == [("MIT", "exact"), ("ISC", "exact")]


def test_source_headers():
    header = "# This {0} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {1}General Public License as published by\n# the Free Software Foundation, either version {2} of the License, or\n# (at your option) any later version.\n"
    for what, kind, v, name in [("program", "", "3", "GPL-3.0"), ("program", "", "2", "GPL-2.0"), ("library", "Lesser ", "2.1", "LGPL-2.1"), ("program", "Affero ", "3", "AGPL-3.0")]:
        assert found(header.format(what, kind, v)) == [(name, "exact")]


def test_spdx_tags():
    assert found("// SPDX-License-Identifier: MIT") == [("MIT", "exact")]
    assert found("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR MIT) */ int x") == [("GPL-2.0", "exact"), ("MIT", "exact")]
    assert found("SPDX-License-Identifier: EPL-2.0\nOR else") == [("EPL-2.0", "exact")]


def test_scan_reads_what_has_no_license_word(spark):
    docs = spark.createDataFrame([(1, full("ISC")), (2, "SPDX-License-Identifier: MIT OR Apache-2.0"), (3, full("GPL-3.0"))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["status"]) for r in L.scan(docs).collect())
    assert got == [(1, "ISC", "exact"), (2, "Apache-2.0", "exact"), (2, "MIT", "exact"), (3, "GPL-3.0", "exact")]
