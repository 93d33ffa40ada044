"""License scans: ordered signature rules behind a keyword prefilter, with interval-containment suppression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import lean, quoted, table

#: Bytes of words: ASCII letters and digits, and everything beyond ASCII.
IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Phrases whose every place is reported, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Signature:
    """pattern: words with ``(?:a|b)`` choices and ``?`` options, one blank for any gap. keyword: a word every match contains."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float

    def compiled(self) -> re.Pattern[bytes]:
        pattern = self.pattern.encode().replace(b" ?", b"\1").replace(b" ", GAP).replace(b"\1", b"(?:" + GAP + b")?")
        return re.compile(rb"(?<!" + WORD + rb")" + pattern + rb"(?!" + WORD + rb")")


def signatures() -> tuple[Signature, ...]:
    """The ordered rules: full notices first (priority 3), then names with versions (2), then bare names (1)."""
    out: list[Signature] = []

    def add(label: str, keyword: str, priority: int, confidence: float, *patterns: str) -> None:
        out.extend(Signature(label, p, keyword, priority, confidence) for p in patterns)

    # GNU family: name, versions, and whether later versions are allowed
    for short, name, versions in (("gpl", "general public license", "1 2 3"), ("lgpl", "(?:lesser|library) general public license", "2 2.1 3"), ("agpl", "affero general public license", "1 3")):
        for v in versions.split():
            tail = v.replace(".", " ") + "(?: 0)?"
            add(f"{short}-{v}-or-later", "license", 3, 0.99, f"gnu {name} (?:as published by the free software foundation )?(?:either )?(?:version |v){tail} (?:of the license )?or (?:at your option )?any later version")
            add(f"{short}-{v}", "license", 2, 0.95, f"(?:gnu )?{name} (?:version |v){tail}", f"version {tail} of the (?:gnu )?{name}")
            add(f"{short}-{v}-or-later", short, 2, 0.95, f"{short} ?v?{tail} or later", f"{short}v{tail} or later")
            add(f"{short}-{v}", short, 1, 0.9, f"{short} (?:version |v)?{tail}", f"{short}v{tail}")
        add(short, "license", 1, 0.7, f"gnu {name}")
    # Creative Commons: elements by version, long and short forms
    names = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
    for short, name in names.items():
        words = short.replace("-", " ")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            tail = v.replace(".", " ")
            add(f"cc-{short}-{v}", "commons", 3, 0.99, f"creative commons {name} (?:version |v)?{tail}(?: international| unported| generic)?")
            add(f"cc-{short}-{v}", "cc", 2, 0.97, f"cc {words} {tail}", f"cc {words} v{tail}")
            add(f"cc-{short}-{v}", "creativecommons", 2, 0.97, f"creativecommons org licenses {words} {tail}")
        add(f"cc-{short}", "commons", 1, 0.9, f"creative commons {name}")
        add(f"cc-{short}", "cc", 1, 0.85, f"cc {words}")
    add("cc0-1.0", "cc0", 2, 0.97, "cc0 1 0(?: universal)?")
    add("cc0-1.0", "cc0", 1, 0.85, "cc0")
    # Permissive and other licenses
    for v in ("1", "1.1", "2"):
        tail = v.replace(".", " ")
        add(f"apache-{v}", "apache", 3, 0.99, f"licensed under the apache license version {tail}(?: 0)?")
        add(f"apache-{v}", "apache", 2, 0.97, f"apache (?:software )?license (?:version |v)?{tail}(?: 0)?", f"apache {tail} 0(?: license)?")
    add("apache", "apache", 1, 0.7, "apache (?:software )?license")
    add("mit", "mit", 3, 0.99, "(?:released |licensed |distributed )under the (?:terms of the )?mit license")
    add("mit", "mit", 2, 0.95, "(?:the )?mit license", "license mit", "mit licensed")
    add("mit", "permission", 3, 0.99, "permission is hereby granted free of charge to any person obtaining a copy")
    for n, word in (("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{n}-clause", "bsd", 2, 0.97, f"(?:{n}|{word}) clause bsd(?: license)?", f"bsd (?:{n}|{word}) clause(?: license)?")
    add("bsd-2-clause", "bsd", 2, 0.95, "(?:simplified|freebsd) bsd license")
    add("bsd-3-clause", "bsd", 2, 0.95, "(?:new|modified|revised) bsd license")
    add("bsd", "bsd", 1, 0.7, "bsd license", "bsd style license")
    add("bsd", "redistribution", 3, 0.9, "redistribution and use in source and binary forms with or without modification are permitted")
    for label, name, versions in (
        ("mpl", "mozilla public license", "1.0 1.1 2.0"), ("epl", "eclipse public license", "1.0 2.0"), ("cddl", "common development and distribution license", "1.0 1.1"),
        ("eupl", "european union public licen[cs]e", "1.0 1.1 1.2"), ("artistic", "artistic license", "1.0 2.0"), ("afl", "academic free license", "1.1 1.2 2.0 2.1 3.0"),
        ("osl", "open software license", "1.0 1.1 2.0 2.1 3.0"), ("ofl", "sil open font license", "1.0 1.1"), ("upl", "universal permissive license", "1.0"), ("bsl", "boost software license", "1.0"),
        ("odbl", "open database license", "1.0"), ("zpl", "zope public license", "1.1 2.0 2.1"), ("lppl", "latex project public license", "1.0 1.1 1.2 1.3"), ("cpl", "common public license", "1.0"),
        ("ecl", "educational community license", "1.0 2.0"), ("cecill", "cecill(?: free software)? license", "1.0 1.1 2.0 2.1"), ("php", "php license", "3.0 3.01"), ("wtfpl", "do what the fuck you want to public license", "1 2"),
    ):
        keyword = name.split()[0].split("(")[0]
        for v in versions.split():
            add(f"{label}-{v}", keyword, 2, 0.97, f"{name} (?:version |v)?{v.replace('.', ' ')}")
            if label not in ("php", "artistic", "cecill", "ofl"):
                add(f"{label}-{v}", label, 1, 0.85, f"{label} (?:version |v)?{v.replace('.', ' ')}")
        add(label, keyword, 1, 0.8, name)
    add("isc", "isc", 2, 0.9, "isc license")
    add("zlib", "zlib", 2, 0.9, "zlib(?: libpng)? license")
    add("unlicense", "unlicense", 2, 0.9, "the unlicense", "unlicense org")
    add("unlicense", "unencumbered", 3, 0.99, "this is free and unencumbered software released into the public domain")
    add("public-domain", "domain", 1, 0.6, "(?:released |dedicated |placed )(?:in|into|to) the public domain", "public domain dedication")
    add("all-rights-reserved", "rights", 1, 0.5, "all rights reserved")
    add("proprietary", "proprietary", 1, 0.6, "proprietary and confidential", "proprietary license")
    return tuple(out)


class Scanner:
    """Runs the rules over one text at a time."""

    def __init__(self, rules: tuple[Signature, ...]):
        self.base = [(label, re.compile(rb"(?<!" + WORD + rb")" + phrase.encode().replace(b" ", GAP) + rb"(?!" + WORD + rb")"), phrase.split()[-1].encode() if label != "mit" else b"mit") for phrase, label in BASE]
        self.highest = -max((r.priority for r in rules), default=0)
        self.by_keyword: dict[bytes, list[tuple[int, Signature, re.Pattern[bytes]]]] = {}
        for i, r in enumerate(rules):
            self.by_keyword.setdefault(r.keyword.encode(), []).append((i, r, r.compiled()))

    def detections(self, low: bytes) -> list[tuple[int, int, Signature]]:
        """Byte spans of signature matches; one that lies within another of higher priority, or of the same and longer, or equal and earlier in the rules, is suppressed."""
        found = [(m.start(), -m.end(), -r.priority, i, r) for keyword, rules in self.by_keyword.items() if keyword in low for i, r, p in rules for m in p.finditer(low)]
        # in this order whatever a span can lie within comes before it, so the farthest end of each priority decides
        found.sort(key=lambda d: d[:4])
        reach: dict[int, int] = {}
        kept: list[tuple[int, int, Signature]] = []
        for start, end, priority, _, r in found:
            if any(reach.get(p, -1) >= -end for p in range(priority, self.highest - 1, -1)):
                continue
            kept.append((start, -end, r))
            reach[priority] = max(reach.get(priority, -1), -end)
        return kept

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        low = text.translate(ASCII_LOWER)
        inside = IS_WORD[np.frombuffer(low, np.uint8)]
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))) if len(low) else np.zeros(0, np.int64)
        places = sorted((m.start(), label) for label, p, keyword in self.base if keyword in low for m in p.finditer(low))
        at = np.searchsorted(starts, [p[0] for p in places])
        labels = {label for _, label in places}
        found = self.detections(low)
        doubt = 1.0
        for conf in [1.0] * len(places) + [r.confidence for _, _, r in found]:
            doubt *= 1 - conf
        more = labels | {r.label for _, _, r in found}
        return len(starts), len(places), int(at[0]) if places else None, int(at[-1]) if places else None, ",".join(sorted(labels)), ",".join(sorted(more)), 1 - doubt


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """One row per row of ``df`` (SCHEMA), without a shuffle: each text is read once, whole.

    Null and empty texts have no words, no labels and score 0; repeated rows each get theirs. A phrase's places are
    counted also where signatures overlap them; signatures only add labels. Other columns play no part; an empty table
    gives an empty one.
    """
    rules = signatures() if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        for b in batches:
            rows = [scanner.scan((t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in b.column(1)]
            cols = [b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")).mapInArrow(lean(run), SCHEMA)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, empty texts and repeated rows as in scan_licenses."""
    return scan_licenses(table(spark, sf_dir, "documents"))
