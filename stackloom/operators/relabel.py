"""Relabelling rules as column expressions over a label map."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.labels import let, overlay, rename_keys, set_label
from stackloom.functions.re2 import java_pattern

DEFAULT_REGEX = "(.*)"
# The rule actions.
ACTIONS = {
    "replace", "keep", "drop", "keepequal", "dropequal", "hashmod", "labelmap", "labeldrop", "labelkeep",
    "lowercase", "uppercase",
}


@dataclass(frozen=True)
class RelabelRule:
    action: str = "replace"
    source_labels: list[str] = field(default_factory=list)
    separator: str = ";"
    regex: str = DEFAULT_REGEX
    target_label: str = ""
    replacement: str = "$1"
    modulus: int = 0


def load_relabel_rules(text: str) -> list[RelabelRule]:
    """Rules of a YAML text with a ``relabel_configs`` list; empty text is an error."""
    if not text:
        raise ValueError("empty config")
    document = yaml.safe_load(text) or {}
    rules = []
    for entry in document.get("relabel_configs") or []:
        unknown = set(entry) - set(RelabelRule.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields in relabel rule: {sorted(unknown)}")
        rule = RelabelRule(**{**entry, "action": str(entry.get("action", "replace")).lower()})
        _check(rule)
        rules.append(rule)
    return rules


def _check(rule: RelabelRule) -> None:
    if rule.action not in ACTIONS:
        raise ValueError(f"unknown relabel action {rule.action!r}")
    if rule.action in {"replace", "hashmod", "lowercase", "uppercase", "keepequal", "dropequal"} \
            and not rule.target_label:
        raise ValueError(f"relabel action {rule.action} needs a target_label")
    java_pattern(rule.regex)  # refuses what rule files may not hold
    if rule.action == "hashmod" and rule.modulus <= 0:
        raise ValueError("hashmod needs a modulus")


def _java(regex: str) -> str:
    """Whole-text form of a rule's pattern."""
    return r"\A(?s:" + java_pattern(regex)[0] + r")\z"


_REFERENCE = re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")


def _expand(template: str, regex: str, text: Column) -> Column:
    """Fill ``$1``, ``${1}``, ``${name}`` from the match of ``text``; unknown groups are empty."""
    _, groups, names = java_pattern(regex)
    parts: list[Column] = []
    position = 0
    for match in _REFERENCE.finditer(template):
        if match.start() > position:
            parts.append(F.lit(template[position:match.start()]))
        position = match.end()
        name = match.group(1) or match.group(2)
        if name is None:
            parts.append(F.lit("$"))
            continue
        number = int(name) if name.isdigit() else names.get(name)
        if number is not None and number <= groups:
            parts.append(F.regexp_extract(text, _java(regex), number))
    if position < len(template):
        parts.append(F.lit(template[position:]))
    return F.concat(*parts) if parts else F.lit("")


def _joined(labels: Column, rule: RelabelRule) -> Column:
    values = [F.coalesce(labels[name], F.lit("")) for name in rule.source_labels]
    return F.concat_ws(rule.separator, *values) if values else F.lit("")


def hashmod(text: Column, modulus: int) -> Column:
    """The low 64 bits of the MD5, unsigned, modulo ``modulus``."""
    low = F.conv(F.substring(F.md5(text), 17, 16), 16, 10).cast("decimal(20,0)")
    return (low % F.lit(modulus).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")


def _key_rule(labels: Column, rule: RelabelRule) -> Column:
    """Rules on label names."""
    def named(key: Column) -> Column:
        return F.rlike(key, F.lit(_java(rule.regex)))

    if rule.action == "labelmap":
        picked = F.map_filter(labels, lambda k, _: named(k))
        return overlay(labels, rename_keys(picked, lambda k: _expand(rule.replacement, rule.regex, k)))
    if rule.action == "labeldrop":
        return F.map_filter(labels, lambda k, _: ~named(k))
    return F.map_filter(labels, lambda k, _: named(k))


def _value_of(rule: RelabelRule, text: Column) -> Column:
    if rule.action == "hashmod":
        return hashmod(text, rule.modulus)
    if rule.action == "lowercase":
        return F.lower(text)
    if rule.action == "uppercase":
        return F.upper(text)
    return _expand(rule.replacement, rule.regex, text)


def _apply(state: Column, rule: RelabelRule) -> Column:
    """The state (``labels``, ``keep``) after a rule. The state before it is bound, so it is worked out once."""
    def ruled(labels: Column, keep: Column) -> Column:
        return F.struct(labels.alias("labels"), keep.alias("keep"))

    def over_text(s: Column) -> Column:
        labels, keep, text = s["state"]["labels"], s["state"]["keep"], s["text"]
        matches = F.rlike(text, F.lit(_java(rule.regex)))
        target = F.coalesce(labels[rule.target_label], F.lit(""))
        verdicts = {"keep": matches, "drop": ~matches, "keepequal": text == target, "dropequal": text != target}
        if rule.action in verdicts:
            return ruled(labels, keep & verdicts[rule.action])
        value = _value_of(rule, text)
        if rule.action != "replace":
            return ruled(set_label(labels, rule.target_label, value), keep)
        if "$" not in rule.target_label:
            return ruled(F.when(matches, set_label(labels, rule.target_label, value)).otherwise(labels), keep)

        def over_target(n: Column) -> Column:
            valid = F.rlike(n["target"], F.lit(r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"))
            return F.when(matches & valid, set_label(labels, n["target"], value)).otherwise(labels)
        return ruled(let(over_target, target=_expand(rule.target_label, rule.regex, text)), keep)

    def over_state(s: Column) -> Column:
        if rule.action in ("labelmap", "labeldrop", "labelkeep"):
            return ruled(_key_rule(s["state"]["labels"], rule), s["state"]["keep"])
        # The joined source values are bound as well: the rule reads them more than once.
        return let(over_text, state=s["state"], text=_joined(s["state"]["labels"], rule))
    return let(over_state, state=state)


def relabel(df: DataFrame, rules: list[RelabelRule], labels: str = "labels", keep: str = "keep") -> DataFrame:
    """Apply the rules in order to the label map; ``keep`` tells whether the row survives.

    A rule reads the map several times, so it binds what the rules before it give and refers to it once. The result is generated,
    which keeps Spark from moving a filter on ``keep``, with a copy of all rules in it, ahead of them. Run this on process
    tables rather than on samples. Labels of rows that are not kept carry no meaning.
    """
    state = F.struct(F.col(labels).alias("labels"), (F.col(keep) if keep in df.columns else F.lit(True)).alias("keep"))
    for rule in rules:
        _check(rule)
        state = _apply(state, rule)
    df = df.select("*", F.explode(F.array(state)).alias("_ruled"))
    return df.withColumns({labels: F.col("_ruled.labels"), keep: F.col("_ruled.keep")}).drop("_ruled")


_LITERAL = re.compile(r"[A-Za-z0-9_\-/ :@,=%#&;!<>\"'~`]+")


def _as_comparison(column: Column, rule: RelabelRule) -> Column | None:
    """A keep or drop rule on one column as a comparison that a scan can take over; None if its pattern is more than fixed texts.

    Fixed texts, lists of them (``a|b``), and a fixed start (``a.*``) are comparisons. A NULL matches none of them.
    """
    body = rule.regex[1:-1] if re.fullmatch(r"\([^()?]*\)", rule.regex) else rule.regex
    parts = body.split("|")
    if all(_LITERAL.fullmatch(p) for p in parts):
        hit = column.isin(parts) if len(parts) > 1 else column == parts[0]
        miss = ~hit if len(parts) > 1 else column != parts[0]
    elif body.endswith(".*") and _LITERAL.fullmatch(body[:-2]):
        hit = F.startswith(column, F.lit(body[:-2]))
        miss = ~hit
    else:
        return None
    return hit if rule.action == "keep" else miss | column.isNull()


def _origins(rules: list[RelabelRule], columns: dict[str, str]):
    """Each rule with what is known of the labels before it: name of the stored column that a label still equals, or '' if absent."""
    known: dict[str, str | None] = dict(columns)  # None: absent on every row
    for rule in rules:
        yield rule, dict(known)
        if rule.action in ("keep", "drop", "keepequal", "dropequal"):
            continue
        if rule.action in ("labeldrop", "labelkeep"):
            try:
                named = {name: bool(re.fullmatch(java_pattern(rule.regex)[0], name, re.S)) for name in known}
            except re.error:  # a pattern of the other dialect
                known = {}
                continue
            known = {n: None if named[n] == (rule.action == "labeldrop") else c for n, c in known.items()}
        elif rule.action == "labelmap" or "$" in rule.target_label:
            known = {}  # may write any label
        else:
            copied = rule.action == "replace" and len(rule.source_labels) == 1 and rule.regex == "(.*)" and rule.replacement == "$1"
            source = rule.source_labels[0] if copied else None
            if copied and source in known:
                known[rule.target_label] = known[source]
            else:
                known.pop(rule.target_label, None)


def stored_predicate(rules: list[RelabelRule], columns: dict[str, str]) -> Column | None:
    """What keep and drop rules say of stored columns: a filter for the scan, ahead of all labelling; None if they say nothing.

    ``columns`` names the labels that equal a stored text column when the rules begin. The rule list is followed symbolically:
    a label counts for as long as no rule can have changed it (replace rules change their target, label maps and computed
    targets may change any label, dropped labels are empty). Rules on other labels are left to :func:`relabel`, which still
    has to run; rows that this filter takes out are rows that it would not keep. Patterns of fixed texts become comparisons that
    reach the files' statistics, others stay pattern matches.
    """
    predicate: Column | None = None
    for rule, known in _origins(rules, columns):
        if rule.action not in ("keep", "drop") or not rule.source_labels or any(name not in known for name in rule.source_labels):
            continue
        values = [F.lit("") if known[name] is None else F.col(known[name]) for name in rule.source_labels]
        name = known[rule.source_labels[0]]
        verdict = _as_comparison(values[0], rule) if len(values) == 1 and name is not None else None
        if verdict is None:
            hit = F.rlike(F.concat_ws(rule.separator, *[F.coalesce(v, F.lit("")) for v in values]), F.lit(_java(rule.regex)))
            verdict = hit if rule.action == "keep" else ~hit
        predicate = verdict if predicate is None else predicate & verdict
    return predicate


def drop_early(df: DataFrame, rules: list[RelabelRule], columns: dict[str, str]) -> DataFrame:
    """``df`` without the rows that keep and drop rules on stored columns take out anyway."""
    predicate = stored_predicate(rules, columns)
    return df if predicate is None else df.where(predicate)


def filter_kept(df: DataFrame, keep: str = "keep") -> DataFrame:
    return df.where(F.col(keep)).drop(keep)
