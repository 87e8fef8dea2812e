"""Rule patterns: what they match, and what is refused."""

import pytest
from pyspark.sql import functions as F

from stackloom.functions.re2 import java_pattern
from stackloom.operators.relabel import RelabelRule, relabel

MATCHES = [
    ("[[:digit:]]x", "5x", True), ("[[:^digit:]]x", "5x", False), ("[^[:space:]]+", "ab", True), (r"\pL+", "äb", True),
    (r"\p{Greek}+", "αβ", True), (r"\p{^Greek}+", "αβ", False), (r"\PL", "7", True), (r"\Qa.b\E+", "a.bb", True), (r"\Qa.b", "a.b", True),
    ("[a&&b]+", "&a", True), ("[[a]+", "[a", True), ("(?i)ABC", "abc", True), ("a{,2}", "a{,2}", True), (r"\x{41}\101", "AA", True),
    ("(?P<n>x)y", "xy", True), ("x$", "x\n", False), (r"(?m)a$.b", "a\nb", True), ("[]a]+", "]a", True),
]


@pytest.mark.parametrize("pattern,text,matches", MATCHES)
def test_matches(one, pattern, text, matches):
    assert one(F.rlike(F.col("t"), F.lit(r"\A(?s:" + java_pattern(pattern)[0] + r")\z")), t=text) is matches


@pytest.mark.parametrize("pattern", [
    "(?=a)", "(?<!a)b", r"(a)\1", "(?>a)", "a++", "a**", "*a", r"\Z", r"\G", "(a", "a)", "[a", r"\k<n>", "(?U)a+", "[[:nope:]]", "(?P<a>x)(?P<a>y)"])
def test_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_groups():
    assert java_pattern(r"(a)(?:b)(?P<last_one>c)[(]\(")[1:] == (2, {"last_one": 2})


def test_named_group_fills_a_label(spark):
    rows = spark.createDataFrame([({"a": "x-42"},)], "labels map<string,string>")
    rule = RelabelRule(source_labels=["a"], regex=r"(?P<the_word>[[:alpha:]]+)-(?P<num>\d+)", target_label="b", replacement="${num}/${the_word}")
    assert relabel(rows, [rule]).first()["labels"]["b"] == "42/x"
