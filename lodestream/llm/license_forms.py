"""Full texts, source headers and usual notices of licenses, besides the short notices of ``license_scan``."""

from __future__ import annotations

import pkgutil


def _text(name: str) -> str:
    return pkgutil.get_data("lodestream.llm", f"licenses/{name}.txt").decode()


_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the organization."""

#: Name, title and version of the GNU licenses.
_GNU = {
    "GPL-1.0": ("GNU General Public License", "1"),
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.0": ("GNU Library General Public License", "2"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
#: What notices call a license.
_TITLES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", '2-Clause BSD License'],
    "BSD-3-Clause": ["BSD 3-Clause License", '3-Clause BSD License'],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    **{name: [f"{title}, version {v}", f"{title} v{v}", f"{title} v{v}.0" if "." not in v else f"{title} {v}"] for name, (title, v) in _GNU.items()},
}
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives"}


def _without(text: str, first: str, last: str) -> str:
    begin = text.index(first)
    return text[:begin] + text[text.index(last, begin) :]


def _gnu(title: str, v: str) -> list[str]:
    """Source headers: with any later version, and of this version only."""
    may = "you can redistribute it and/or modify it under the terms of"
    by = "as published by the Free Software Foundation"
    return [
        f"This {what} is free software; {may} the {title} {by}; either version {v} of the License, or (at your option) any later version." for what in ("program", "library")
    ] + [
        f"{may} the {title} {by}; version {v} of the License.",
        f"{may} the {title} {by}; version {v}.",
        f"{may} the {title}, version {v}, {by}.",
        f"{may} version {v} of the {title} {by}.",
    ]


def more_forms() -> list[tuple[str, str]]:
    """License and wording."""
    found = [(name, _text(name)) for name in ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")]
    mit, isc, bsd, gpl = _text("MIT"), _text("ISC"), _text("BSD-3-Clause"), _text("GPL-3.0")
    found += [
        ("MIT-0", _without(mit, ", subject to the following", "THE SOFTWARE IS PROVIDED")),
        ("0BSD", _without(isc, ", provided that the above", "THE SOFTWARE IS PROVIDED")),
        ("BSD-2-Clause", _without(bsd, "3. Neither", "THIS SOFTWARE IS PROVIDED")),
        ("BSD-4-Clause", bsd.replace("3. Neither", _ADVERTISING + "\n\n4. Neither")),
        # its own preamble and section 13 count as differences, so it is found as altered
        ("AGPL-3.0", gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("GNU General Public License", "GNU Affero General Public License")),
        ("Apache-2.0", _APACHE),
        ("MPL-2.0", _MPL),
        ("CC0-1.0", _CC0),
    ]
    found += [(name, form) for name, (title, v) in _GNU.items() for form in _gnu(title, v)]
    for name, titles in _TITLES.items():
        for title in titles:
            found += [(name, f"{how} the {title}") for how in ("licensed under", "licensed under the terms of", "released under", "distributed under")]
    for name, kind in _CC.items():
        found += [(name, f"licensed under a Creative Commons {kind} 4.0 International License"), (name, f"Creative Commons {kind} 4.0 International Public License")]
    return found
