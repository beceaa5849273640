"""Identifier tags wherever the automaton finds them, and families of identifiers."""

import pytest

from lexmill.llm import license

FOUND = license.automaton()


@pytest.mark.parametrize(
    "text, labels, permissive",
    [
        ("SPDX-License-Identifier: Zlib", "zlib", True),
        ("# SPDX-License-Identifier: 0BSD OR CDDL-1.0", "bsd,cddl", True),
        ("SPDX-License-Identifier: GPLv2", "gpl", False),
        ("SPDX-License-Identifier: BSL-1.0 AND OFL-1.1", "bsl,ofl", True),
        ("SPDX - License - Identifier: MIT", "mit", True),
        ("spdx_license/identifier :\tMS-RL\nMIT", "ms-rl", False),
        ("über SPDX-License-Identifier: LGPL-2.1+ WITH x OR X11\r\nand SPDX-License-Identifier EPL-2.0", "epl,lgpl,mit", False),
        ("SPDX-License-Identifier: Mitre-1", "other", False),
        ("We put an SPDX license identifier in each file.", "", None),
        ("SPDX-License-Identifier:", "", None),
    ],
)
def test_tags(text, labels, permissive):
    assert license.scan(text.encode(), FOUND)[5] == labels and license.scan(text.encode(), FOUND)[8] is permissive


def test_notices_and_long_texts():
    text = "words that stand here. " * 50_000 + "In no event will the authors be held liable for any damages arising from the use of this software."
    assert license.scan(text.encode(), FOUND)[5] == "zlib"
    tags = "x SPDX-License-Identifier: MIT\n" * 20_000
    assert len(license.scan(tags.encode(), FOUND)[7]) == 20_000


def test_families():
    names = "GPL-3.0-or-later LGPLv2.1 AGPL-3.0 Apache2.0 BSD-3-Clause CC-BY-NC-SA-4.0 CC-BY-4.0 CC0-1.0 MIT-0 PSF-2.0 Python-2.0 W3C-20150513 Unlicense ISC".lower().split()
    assert [license.family(n) for n in names] == "gpl lgpl agpl apache bsd cc-by-nc cc-by cc0 mit psf psf w3c unlicense isc".split()
    assert {license.family(n) for n in ("gplx", "mitigate", "iscariot", "zlibrary")} == {"other"}
    assert license.COPYLEFT <= set(license.FAMILIES.values())
