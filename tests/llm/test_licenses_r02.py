"""Licence texts as they stand in repositories, wrapped and commented, near misses, breaks and odd tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_advice_r01 import APACHE, BSD2, BSD3, GPL, ISC, MIT

from missive.llm import licenses

ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
GPL3_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
GPL2_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc."""
LGPL_FILE = """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999
"""
AGPL_FILE = """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007
"""
APACHE_FILE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/
"""
MPL_FILE = """Mozilla Public License Version 2.0
==================================

1. Definitions"""
CC_BY_SA = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."
CC_BY = "Creative Commons Attribution 4.0 International Public License\n\nBy exercising the Licensed Rights"
CC0 = "Creative Commons Legal Code\n\nCC0 1.0 Universal\n"
GPL2_ONLY = """This file is free software; you can redistribute it and/or modify it under the
terms of the GNU General Public License version 2 as published by the Free
Software Foundation."""
UNLICENSE = "This is free and unencumbered software released into the public domain."
SPDX = {
    "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only", "# SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
    "# SPDX-License-Identifier: (GPL-2.0 OR MIT)": "MIT,GPL-2.0-only", "SPDX-License-Identifier: MIT AND BSD-3-Clause": "BSD-3-Clause,MIT", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0-or-later",
    "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0", "SPDX-License-Identifier: Nobody-1.0": "", "spdx-license-identifier:ISC": "ISC", "SPDX-License-Identifier: EPL-2.0\r\nx": "EPL-2.0",
}
TEXTS = {
    "Zlib": ZLIB, "BSL-1.0": BOOST, "GPL-3.0": GPL3_FILE, "GPL-2.0": GPL2_FILE, "LGPL-2.1": LGPL_FILE, "AGPL-3.0": AGPL_FILE, "Apache-2.0": APACHE_FILE, "MPL-2.0": MPL_FILE, "CC-BY-SA-4.0": CC_BY_SA,
    "CC-BY-4.0": CC_BY, "CC0-1.0": CC0, "GPL-2.0-only": GPL2_ONLY, "Unlicense": UNLICENSE, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "MIT": MIT, "ISC": ISC,
}


def scan(spark, texts):
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)]


def test_license_files_and_notices(spark):
    assert scan(spark, TEXTS.values()) == list(TEXTS)
    assert scan(spark, ["\n".join(f"// {x}".rstrip() for x in t.split("\n")) for t in TEXTS.values()]) == list(TEXTS)
    assert scan(spark, [f"Some file.\n\n{t}\n\nint main(void);" for t in TEXTS.values()]) == list(TEXTS)


def test_spdx_lines(spark):
    assert scan(spark, SPDX) == list(SPDX.values())


def test_texts_that_only_look_like_licenses(spark):
    near = [
        MIT.replace("without restriction", "with restriction"), BSD2.replace("source code must", "source code should"), GPL.replace("Free Software Foundation", "Some Foundation"), APACHE.replace("Version 2.0", "Version 9.0"),
        ISC.replace("with or without fee", "without fee"), "GNU General Public License\n\nsome words\n\nVersion 3, 29 June 2007", "The MIT Licensed people", "not released under the MIT License", "released under the MIT License or not", "BSD",
    ]
    assert scan(spark, near) == [""] * len(near)


def test_sentences_apart_are_no_license(spark):
    """The sentences of a licence with other text between them are none; copyright lines and numbers may stand there."""
    parts = BSD2.split("\n\n")
    assert scan(spark, ["\n\n".join(parts), "\n\nCopyright (c) 2001 Some Body\n\n".join(parts), "\n\nand now for something else\n\n".join(parts), "\n\n**\n\n".join(parts)]) == ["BSD-2-Clause", "BSD-2-Clause", "", "BSD-2-Clause"]
    body = MIT.split("\n\n")
    assert scan(spark, ["\n\n".join(body[:3]) + "\n\n" + "Pages of prose. " * 300 + "\n\n" + "\n\n".join(body[3:])]) == [""]
    both = f"{MIT}\n\nThe other part:\n\n{BSD3}"
    assert scan(spark, [both]) == ["BSD-3-Clause,MIT"]


def test_license_scan_of_odd_tables(spark):
    rows = [(1, MIT), (1, MIT), (None, MIT), (2, None), (3, ""), (4, "licence " * 200_000), (5, "MIT License\n" * 20_000), (6, ("copyright notice; " * 50 + "\n") * 2000 + MIT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("rest0", F.lit(1)).withColumn("marked", F.lit(2))
    got = licenses.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.licenses) for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, ""), (3, ""), (4, ""), (5, ""), (6, "MIT")]
    assert {r.n_sentences for r in got if r.doc_id == 5} == {20_000}
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_license_sql_knows_breaks(spark, tmp_path):
    said = [
        "Released under the MIT License.", "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", "a licence\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0 (the License);\nothers know why\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nand so on", "All rights reserved. 7\nCopyright 2020 me\nUnder no license", None, "",
    ]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = connection.execute(licenses.oracle_sql()).fetchall()
    assert sorted(map(tuple, licenses.op2_license_scan(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(licenses.SPDX))
def test_every_spdx_name_is_read(spark, name):
    assert name in licenses._spdx().values()
