"""Notices wrapped over lines, in comments, and beside other notices."""

import textwrap

import pytest

from fieldglass.llm import licences

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_wrapped_notices(spark, model):
    long = [(f, t) for f, t in licences.TEMPLATES if len(t) > 120]
    rows = []
    for family, notice in long:
        for width in (30, 50, 76):
            lines = textwrap.wrap(notice, width)
            rows += [
                (family, "\n".join(lines)), (family, "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() {}"),
                (family, "\n".join(f"dnl {x}" for x in lines)), (family, "Some words before it\n" + "\r\n".join(lines) + "\nand words after it"),
            ]
    both = "\n".join([*textwrap.wrap(long[0][1].rstrip("."), 60), "", *textwrap.wrap(licences.TEMPLATES[6][1].rstrip("."), 60)])
    rows += [("apache-2.0,mit", both), ("apache-2.0,mit", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0"), ("", "He lost his driving\nlicense under the\nbridge")]
    df = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(rows)], "i int, expected string, text string")
    out = licences.families_of_documents(df, model=model).collect()
    assert len(long) > 3 and [(r["i"], r["licences"]) for r in out if r["licences"] != r["expected"]] == []
    assert {r["confirmed"] for r in out if r["i"] < len(rows) - 3} == {1}
