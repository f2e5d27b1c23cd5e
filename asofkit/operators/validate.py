"""Validation of nested records: model answers in strict JSON, annotations with evidence spans, sectioned answers."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The ranges and categories of an extraction record.
RANGES = {
    "sentiment": (-2, 2), "risk": (0, 2), "uncertainty": (0, 2), "growth_outlook": (-2, 2), "financial_strength": (-2, 2),
    "fundamental_impact": (-2, 2), "price_narrative": (0, 2), "relevance": (0, 2), "short_term_impact": (-2, 2), "long_term_impact": (-2, 2),
}
EVENTS = (
    "earnings", "guidance", "product", "demand", "supply_chain", "regulation", "competition", "management", "partnership",
    "market_price", "macroeconomic", "litigation", "other",
)
LISTS = ("positive_factors", "potential_concerns", "evidence")
EXTRACTION_KEYS = (*RANGES, "event_type", "positive_factors", "potential_concerns", "summary", "evidence")
# The keys and dimensions of an annotation.
ANNOTATION_KEYS = ("sample_id", "ticker", "source_type", "published_at", "as_of_date", "title", "text", "labels", "evidence", "annotator", "annotation_version", "split")
DIRECTIONAL = ("sentiment", "growth_outlook", "financial_strength", "fundamental_impact", "short_term_impact", "long_term_impact")
YES_NO = ("risk_presence", "uncertainty_presence", "relevance", "price_narrative")
_SENTENCE_ENDS = re.compile(r"(?<=[.!?。！？])\s+|[。！？]")

EXTRACTION_SCHEMA = ", ".join([f"{k} int" for k in RANGES] + ["event_type string", *(f"{k} array<string>" for k in LISTS), "summary string", "error string"])


def _once(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _no_constant(name):
    raise ValueError(f"{name} is no JSON value")


_STRICT = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_constant)


def strict_value(text: str):
    """A text that is one JSON value and nothing else."""
    return _STRICT.decode(text)


def first_object(text: str) -> dict:
    """The first object in a text, whatever stands around it; an error for doubled keys, NaN, and unfinished objects."""
    at = text.find("{")
    if at < 0:
        raise ValueError("no object")
    return _STRICT.raw_decode(text, at)[0]


def sentence_count(text: str) -> int:
    return sum(1 for s in _SENTENCE_ENDS.split(text.strip()) if s.strip())


def check_extraction(value: dict, source: str) -> list[str]:
    """What is wrong with an extraction record on a source text."""
    if not isinstance(value, dict):
        return ["not an object"]
    if set(value) != set(EXTRACTION_KEYS):
        return [f"keys: missing {sorted(set(EXTRACTION_KEYS) - set(value))}, extra {sorted(set(value) - set(EXTRACTION_KEYS))}"]
    wrong = [k for k, (low, high) in RANGES.items() if type(value[k]) is not int or not low <= value[k] <= high]
    if value["event_type"] not in EVENTS:
        wrong.append("event_type")
    for k in LISTS:
        items = value[k]
        if not isinstance(items, list) or len(items) > 4 or not all(isinstance(x, str) and x.strip() and len(x) <= 240 for x in items):
            wrong.append(k)
    if not isinstance(value["summary"], str) or len(value["summary"]) > 600 or sentence_count(value["summary"]) > 2:
        wrong.append("summary")
    if "evidence" not in wrong and any(x.casefold() not in source.casefold() for x in value["evidence"]):
        wrong.append("evidence not in text")
    return wrong


def extractions(df: DataFrame, key: str, answer: str, source: str) -> DataFrame:
    """`key` and the fields of each answer's extraction record, with `error`; an answer that fails has null fields and says why, and harms no other row."""
    types = dict(df.dtypes)

    def run(frames):
        for frame in frames:
            rows = []
            for k, a, s in zip(frame["k"], frame["a"], frame["s"]):
                try:
                    value = first_object(a or "")
                    wrong = check_extraction(value, s or "")
                except (ValueError, RecursionError) as e:
                    value, wrong = None, [str(e)]
                rows.append({"k": k, **({} if wrong else {f: value[f] for f in EXTRACTION_KEYS}), "error": "; ".join(wrong)})
            out = pd.DataFrame(rows, columns=["k", *EXTRACTION_KEYS, "error"])
            for f in RANGES:
                out[f] = out[f].astype("Int32")
            for f in (*LISTS, "event_type", "summary"):
                out[f] = out[f].astype(object).where(out[f].notna(), None)
            yield out[["k", *RANGES, "event_type", *LISTS, "summary", "error"]]

    made = df.select(F.col(key).alias("k"), F.col(answer).alias("a"), F.col(source).alias("s")).mapInPandas(run, f"k {types[key]}, {EXTRACTION_SCHEMA}")
    return made.withColumnRenamed("k", key)


def annotated_text(title: str, text: str) -> str:
    """The text that evidence offsets count in."""
    return f"{title}\n{text}" if title else text


def _utc(value) -> datetime:
    t = datetime.fromisoformat(value)
    if t.tzinfo is None:
        raise ValueError("no offset")
    return t.astimezone(timezone.utc)


def check_annotation(record) -> list[str]:
    """What is wrong with one annotation."""
    if not isinstance(record, dict):
        return ["record is no object"]
    wrong = [f"missing {k}" for k in sorted(set(ANNOTATION_KEYS) - set(record))] + [f"unknown {k}" for k in sorted(set(record) - set(ANNOTATION_KEYS))]
    get = record.get
    filled = lambda k: isinstance(get(k), str) and bool(get(k).strip())
    wrong += [k for k in ("sample_id", "text", "annotator") if not filled(k)]
    wrong += [k for k, ok in (
        ("ticker", isinstance(get("ticker"), str) and re.fullmatch(r"[A-Z][A-Z0-9.-]{0,9}", get("ticker"))), ("source_type", get("source_type") in ("news", "earnings_call", "ten_k")),
        ("split", get("split") in ("train", "validation", "test")), ("title", isinstance(get("title"), str)), ("annotation_version", get("annotation_version") == "v1"),
    ) if not ok]
    try:
        published = _utc(get("published_at"))
    except (TypeError, ValueError):
        published = None
        wrong.append("published_at")
    try:
        day = date.fromisoformat(get("as_of_date")) if re.fullmatch(r"\d{4}-\d\d-\d\d", get("as_of_date")) else None
        if day is None or published and day != published.date():
            wrong.append("as_of_date")
    except (TypeError, ValueError):
        wrong.append("as_of_date")
    labels, evidence = (get(k) if isinstance(get(k), dict) else {} for k in ("labels", "evidence"))
    wrong += [f"{k} is no object" for k in ("labels", "evidence") if not isinstance(get(k), dict)]
    every = {*DIRECTIONAL, *YES_NO}
    wrong += [f"missing label {d}" for d in sorted(every - set(labels))] + [f"unknown dimension {d}" for d in sorted((set(labels) | set(evidence)) - every)]
    source = annotated_text(get("title"), get("text")) if isinstance(get("title"), str) and isinstance(get("text"), str) else ""
    for d in (*DIRECTIONAL, *YES_NO):
        label, items = labels.get(d), evidence.get(d, [])
        allowed = ("negative", "neutral", "positive", "insufficient_information") if d in DIRECTIONAL else ("yes", "no")
        if label not in allowed:
            wrong.append(f"label {d}")
        if not isinstance(items, list):
            wrong.append(f"evidence {d}")
            continue
        if label in ("negative", "neutral", "positive", "yes") and label in allowed and not items:
            wrong.append(f"no evidence {d}")
        if label == "insufficient_information" and items:
            wrong.append(f"evidence against {d}")
        for i, x in enumerate(items):
            ok = isinstance(x, dict) and set(x) == {"quote", "start", "end"} and isinstance(x["quote"], str) and x["quote"] and type(x["start"]) is int is type(x["end"]) and 0 <= x["start"] < x["end"] <= len(source)
            if not ok or source[x["start"] : x["end"]] != x["quote"]:
                wrong.append(f"evidence {d}[{i}]")
    return wrong


def annotations(lines: DataFrame) -> DataFrame:
    """line_no, sample_id, split, title, text, labels, errors of each line of JSON of (line_no, value); a blank line is an error, and an id seen before is one, naming its first line."""

    def run(frames):
        for frame in frames:
            rows = []
            for n, line in zip(frame["line_no"], frame["value"]):
                record, wrong = None, []
                try:
                    record = strict_value(line) if line and line.strip() else None
                    wrong = check_annotation(record) if line and line.strip() else ["blank line"]
                except ValueError as e:
                    wrong = [f"no JSON: {e}"]
                r = record if isinstance(record, dict) else {}
                text = lambda k: r[k] if isinstance(r.get(k), str) else None
                labels = r.get("labels") if isinstance(r.get("labels"), dict) else {}
                rows.append((n, text("sample_id"), text("split"), text("title"), text("text"), {str(k): str(v) for k, v in labels.items()}, wrong))
            yield pd.DataFrame(rows, columns=["line_no", "sample_id", "split", "title", "text", "labels", "errors"])

    out = lines.select("line_no", "value").mapInPandas(run, "line_no long, sample_id string, split string, title string, text string, labels map<string,string>, errors array<string>")
    first = out.filter("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min("line_no").alias("_first"))
    again = F.when(F.col("line_no") > F.col("_first"), F.array(F.concat(F.lit("sample_id of line "), F.col("_first").cast("string"))))
    return out.join(first, "sample_id", "left").select("line_no", "sample_id", "split", "title", "text", "labels", F.concat("errors", F.coalesce(again, F.array().cast("array<string>"))).alias("errors"))


def evidence_matches(source: Column, quote: Column, start: Column, end: Column) -> Column:
    """Whether source[start:end] is the quote, counted in characters from 0."""
    return F.coalesce((start >= 0) & (end > start) & (end <= F.length(source)) & (source.substr(start + 1, end - start) == quote), F.lit(False))


def free_label(answer: Column, labels: list[str]) -> Column:
    """The label an answer is, but for one full stop, outer spaces and case; null for anything else."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(answer, r"^\s+|\s+$", ""), r"\s*\.$", ""))
    out = F.lit(None).cast("string")
    for x in labels:
        out = F.when(clean == x.lower(), x).otherwise(out)
    return out


_HEADS = {
    "positive_developments": r"(?im)^\W*positive developments\W*$",
    "potential_concerns": r"(?im)^\W*potential concerns\W*$",
    "analysis": r"(?im)^\W*(?:prediction\s*(?:&|and)\s*)?analysis\W*$",
}


def sections(answer: str | None) -> dict[str, list[str] | str]:
    """The numbered items of an answer's sections, and its analysis; empty where a heading is missing."""
    text = answer or ""
    marks = sorted((m.start(), m.end(), k) for k, p in _HEADS.items() if (m := re.search(p, text)))
    out: dict[str, list[str] | str] = {"positive_developments": [], "potential_concerns": [], "analysis": ""}
    for (_, begin, k), nxt in zip(marks, [*(m[0] for m in marks[1:]), len(text)]):
        body = text[begin:nxt].strip()
        out[k] = body if k == "analysis" else [m[1].strip() for m in re.finditer(r"(?m)^\s*\d+[.)]\s+(.+)$", body)]
    return out


_TEXTS = ArrayType(StringType())
_SECTIONS = StructType([StructField("positive_developments", _TEXTS), StructField("potential_concerns", _TEXTS), StructField("analysis", StringType()), StructField("missing", _TEXTS)])


@F.pandas_udf(_SECTIONS)
def sections_udf(answer: pd.Series) -> pd.DataFrame:
    rows = [sections(a) for a in answer]
    return pd.DataFrame({**{k: [r[k] for r in rows] for k in _HEADS}, "missing": [[k for k in _HEADS if not r[k]] for r in rows]})


def object_with_keys(text: str | None, keys: list[str]) -> tuple[dict | None, str]:
    """A text that is one JSON object with just these keys in this order; else null and why."""
    try:
        value = json.loads((text or "").strip())
    except ValueError as e:
        return None, str(e)
    if not isinstance(value, dict):
        return None, "not an object"
    return (value, "") if list(value) == keys else (None, f"keys {list(value)}")
