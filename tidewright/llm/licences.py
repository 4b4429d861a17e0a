"""Licence scan: ordered signature rules behind a keyword filter; stronger detections suppress those inside them."""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import map_texts

#: Phrases that always count, wherever their words stand consecutively, and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Names as they stand in normalised text (lower case, one space between words); label: pattern. Each starts with a plain word.
NAMES = {
    "mit": r"mit", "apache-2": r"apache(?: license)?(?: version)? 2(?: 0)?", "apache-1.1": r"apache(?: license)?(?: version)? 1 1",
    "bsd-2-clause": r"bsd 2 clause|simplified bsd", "bsd-3-clause": r"bsd 3 clause|modified bsd|new bsd", "bsd-4-clause": r"bsd 4 clause|original bsd",
    "0bsd": r"0bsd|zero clause bsd", "isc": r"isc", "zlib": r"zlib", "boost-1.0": r"boost software|bsl 1 0", "unlicense": r"unlicense",
    "wtfpl": r"wtfpl", "gpl-1": r"gpl (?:v|version )?1(?: 0)?", "gpl-2": r"gpl ?(?:v|version )?2(?: 0)?|gnu general public license (?:v|version )2",
    "gpl-3": r"gpl ?(?:v|version )?3(?: 0)?|gnu general public license (?:v|version )3", "lgpl-2.1": r"lgpl ?(?:v|version )?2 1|gnu lesser general public license (?:v|version )2 1",
    "lgpl-3": r"lgpl ?(?:v|version )?3(?: 0)?|gnu lesser general public license (?:v|version )3", "agpl-3": r"agpl ?(?:v|version )?3(?: 0)?|gnu affero general public license",
    "gpl": r"gpl|gnu general public", "lgpl": r"lgpl|gnu lesser general public", "gfdl": r"gfdl|gnu free documentation", "mpl-1.1": r"mpl 1 1|mozilla public license (?:version )?1 1",
    "mpl-2": r"mpl 2(?: 0)?|mozilla public license (?:version )?2(?: 0)?", "epl-1": r"epl 1(?: 0)?|eclipse public license (?:v |version )?1(?: 0)?",
    "epl-2": r"epl 2(?: 0)?|eclipse public license (?:v |version )?2(?: 0)?", "eupl-1.2": r"eupl(?: 1 2)?|european union public", "cddl-1": r"cddl(?: 1 [01])?|common development and distribution",
    "artistic-1": r"artistic(?: license)? 1(?: 0)?", "artistic-2": r"artistic(?: license)? 2(?: 0)?", "python-2": r"psf|python software foundation", "ofl-1.1": r"ofl(?: 1 1)?|open font",
    "cc0-1": r"cc0(?: 1 0)?|creative commons zero", "cc-by": r"cc by(?: [1-4] \d)?|creative commons attribution(?: [1-4] \d)?",
    "cc-by-sa": r"cc by sa(?: [1-4] \d)?|creative commons attribution share ?alike(?: [1-4] \d)?", "cc-by-nd": r"cc by nd(?: [1-4] \d)?|creative commons attribution no ?deriv\w+",
    "cc-by-nc": r"cc by nc(?: [1-4] \d)?|creative commons attribution non ?commercial(?: [1-4] \d)?", "cc-by-nc-sa": r"cc by nc sa(?: [1-4] \d)?|creative commons attribution non ?commercial share ?alike",
    "cc-by-nc-nd": r"cc by nc nd(?: [1-4] \d)?|creative commons attribution non ?commercial no ?deriv\w+", "odbl-1": r"odbl(?: 1 0)?|open database", "odc-by": r"odc by|open data commons attribution",
    "pddl-1": r"pddl|public domain dedication and", "ms-pl": r"ms pl|microsoft public", "ms-rl": r"ms rl|microsoft reciprocal", "ncsa": r"ncsa|university of illinois ncsa open source",
    "postgresql": r"postgresql", "openssl": r"openssl", "php-3": r"php 3(?: 01)?", "ruby": r"ruby", "vim": r"vim", "w3c": r"w3c", "x11": r"x11", "afl-3": r"afl 3(?: 0)?|academic free", "osl-3": r"osl 3(?: 0)?|open software",
    "bsl-1.1": r"bsl 1 1|business source", "sspl-1": r"sspl(?: 1)?|server side public", "elastic-2": r"elastic 2(?: 0)?|elastic license 2", "polyform": r"polyform", "openrail": r"openrail(?: m)?|rail m",
    "llama": r"llama(?: \d)? community", "unicode": r"unicode dfs|unicode license v3", "mulan-2": r"mulan psl (?:v)?2", "cecill": r"cecill(?: 2 1| b| c)?", "upl-1": r"upl 1 0|universal permissive", "blueoak": r"blue ?oak model",
}
# How a name is met, from the strongest on: (priority, confidence, pattern around the name, words of which one must stand in the text).
FORMS = (
    (1, 0.99, r"spdx license identifier (?:{n})", ("spdx",)),
    (2, 0.95, r"(?:licen[sc]ed|released|distributed|available|provided|published|made available) under (?:the )?(?:terms of the )?(?:{n})(?: licen[sc]e| international| public licen[sc]e)?", ("under",)),
    (3, 0.9, r"(?:under|subject to|according to|governed by) (?:the )?(?:terms of the )?(?:{n}) licen[sc]e", ("under", "subject", "according", "governed")),
    (4, 0.8, r"(?:{n}) (?:public |software )?licen[sc]es?(?: version \d(?: \d)?)?", ("licen",)),
    (5, 0.6, r"licen[sc]e (?:is |type )?(?:the )?(?:{n})", ("licen",)),
)
# Names that mean a licence wherever they stand: (priority, confidence) and beginnings of their labels.
ALONE = (6, 0.5, ("apache", "bsd-", "gpl-", "lgpl-", "agpl-", "mpl-", "epl-", "cc0", "cc-by", "odc-by", "mulan"))
# Sentences that give a licence away without its name: label, pattern, word that must stand in the text.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "distribute"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither"),
    ("bsd-2-clause", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public", "redistribute"),
    ("lgpl", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public", "redistribute"),
    ("apache-2", r"you may not use this file except in compliance with the license", "compliance"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("unlicense", r"free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented"),
    ("wtfpl", r"you just do what the fuck you want to", "fuck"),
    ("proprietary", r"all rights reserved", "reserved"),
    ("public-domain", r"(?:dedicated to|released into|placed in|in) the public domain", "domain"),
    ("no-licence", r"(?:may not be|no part .{1,60}? may be) (?:reproduced|copied|distributed)", "may"),
)


def _heads(name: str) -> list[str]:
    """The plain words that the alternatives of a name begin with."""
    return [re.match(r"[a-z0-9]+", alt)[0] for alt in re.split(r"\|(?![^(]*\))", name)]


@functools.cache
def rules():
    """All rules, strongest first: (priority, confidence, label, compiled pattern), and an automaton from keywords to rules.

    A rule runs only on texts that hold one of its keywords, and where it has a plain name to look for, that too.
    """
    made, wants = [], []
    for priority, confidence, form, words in FORMS:
        for label, name in NAMES.items():
            made.append((priority, confidence, label, re.compile(r"(?<!\S)" + form.replace("{n}", name) + r"(?!\S)")))
            wants.append((words, _heads(name)))
    for label, name in NAMES.items():
        if label.startswith(ALONE[2]):
            made.append((*ALONE[:2], label, re.compile(rf"(?<!\S)(?:{name})(?!\S)")))
            wants.append((_heads(name), _heads(name)))
    for label, pattern, word in SENTENCES:
        made.append((2, 0.9, label, re.compile(r"(?<!\S)(?:" + pattern + r")(?!\S)")))
        wants.append(((word,), [word]))
    return made, wants


@functools.cache
def keywords():
    """Automaton over every keyword: one pass over a text tells which of them it holds."""
    found = ahocorasick.Automaton()
    for words in {w for a, b in rules()[1] for w in (*a, *b)}:
        found.add_word(words, words)
    found.make_automaton()
    return found


#: Bytes to words: A-Z to lower case, ASCII digits and letters and all bytes beyond ASCII stay, the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def detections(line: str) -> list[tuple[int, int, int, float, str]]:
    """(priority, start, end, confidence, label) over a normalised text, without those that a stronger one covers.

    A detection goes if its interval lies within that of one of higher priority, or of the same priority and longer; of equal
    intervals the rule that stands first stays.
    """
    held = {w for _, w in keywords().iter(line)}
    if not held:
        return []
    found = []
    for at, ((priority, confidence, label, pattern), (near, heads)) in enumerate(zip(*rules())):
        if held.isdisjoint(near) or held.isdisjoint(heads):
            continue
        found += [(priority, m.start(), m.end(), confidence, label, at) for m in pattern.finditer(line)]
    found.sort(key=lambda d: (d[1], -d[2], d[0], d[5]))  # whatever covers a detection with better right stands before it
    reach, kept = dict.fromkeys({d[0] for d in found}, 0), []
    for d in found:
        if all(end < d[2] for priority, end in reach.items() if priority <= d[0]):
            kept.append(d)
        reach[d[0]] = max(reach[d[0]], d[2])
    return [d[:5] for d in sorted(kept, key=lambda d: (d[0], d[1] - d[2], d[5], d[1]))]


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text; spans are (label, first word, words)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    line = b" ".join(words).decode("utf-8", "surrogatepass")
    starts, base, padded, blanks = [], set(), None, None

    def word_at(places):
        nonlocal blanks
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        return np.searchsorted(blanks, places).tolist()

    for phrase, label in BASE.items():
        if phrase not in line:
            continue
        padded, at = padded or f" {line} ", -1
        while (at := padded.find(f" {phrase} ", at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    starts = word_at(starts) if starts else starts
    found = detections(line)
    labels, doubt = base | {d[4] for d in found}, 1.0
    for confidence in [0.95] * len(base) + [d[3] for d in found]:
        doubt *= 1.0 - confidence
    spans = [(d[4], a, b - a + 1) for d, a, b in zip(found, word_at([d[1] for d in found]), word_at([d[2] for d in found]))] if found else []
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 - doubt if labels else 0.0, spans)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``df``: ``doc_id``, word count, base phrases, labels, score and ``spans`` (label, first word, words) of the detections.

    Null and empty texts have no words, no labels, score 0 and null first and last word. Repeated rows repeat; long texts are scanned whole,
    in time about linear in their length. Other columns of ``df``, whatever their names, take no part. Empty table: no rows.
    """
    def make():
        def fn(texts):
            *cols, spans = zip(*map(scan_text, texts)) if texts else ([],) * 8
            return [*map(list, cols), [[dict(zip(("label", "start", "n"), s)) for s in x] for x in spans]]
        return fn

    return map_texts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", make,
                     "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                     "spans array<struct<label:string,start:long,n:long>>")
