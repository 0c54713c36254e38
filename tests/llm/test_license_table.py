"""The whole table of licenses: versions and kin apart, one name at a place, full texts."""

from sievemill.llm.license_scan import scan_licenses
from sievemill.llm.license_templates import licenses

GNU = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    "{}THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
ENDORSE = "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
CASES = {
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 7.": "",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "Licensed under the GNU General Public License v2. Released under the GNU General Public License v3.": "GPL-2.0,GPL-3.0",
    GNU.format("This program", "General Public License", 2): "GPL-2.0-header",
    GNU.format("This program", "General Public License", 3): "GPL-3.0-header",
    GNU.format("This program", "Affero General Public License", 3): "AGPL-3.0-header",
    GNU.format("This library", "Lesser General Public License", "2.1"): "LGPL-2.1-header",
    BSD.format(""): "BSD-2-Clause-text",
    BSD.format("3. " + ENDORSE): "BSD-3-Clause-text",
    BSD.format("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software by X.\n4. " + ENDORSE): "BSD-4-Clause-text",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.": "CC-BY-ND-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "Released under CC0 1.0 Universal.": "CC0-1.0",
    "Released under the Eclipse Public License 2.0": "EPL-2.0",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "Unlicense-text",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.": "ISC-text",
}


def test_versions_and_kin(spark):
    texts = [f"lorem ipsum {text} dolor sit amet" for text in CASES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(CASES.values())


def test_every_template_is_its_own(spark):
    table = licenses()
    docs = spark.createDataFrame([(k, t.text) for k, t in table.items()], "doc_id string, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(docs).collect()}
    assert {k: k.split("~")[0] for k in table} == got
    assert {"GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "MPL-2.0-text", "Apache-2.0-text", "CC0-1.0-text"} <= set(got.values())
