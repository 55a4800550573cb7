"""License scans with ordered signature rules (operator 9)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.common import col, table, whole

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WORD = rb"0-9a-z\x80-\xff"
_GAP = rb"[^" + _WORD + rb"]+"
_SPLIT = bytes(c if (48 <= c < 58 or 97 <= c < 123 or c >= 128) else 32 for c in range(256))

#: Forms of a rule, by priority: what a reader would trust most comes last.
MENTION, TITLE, VERSION, NOTICE, TAG = 1, 2, 3, 4, 5
CONFIDENCE = {MENTION: 0.4, TITLE: 0.6, VERSION: 0.8, NOTICE: 0.9, TAG: 1.0}

#: label | names, in words, separated by ";" | tags | versions.  A name may hold (a|b), x? and so on.
SIGNATURES = """
gpl | gnu general public licen[sc]e;general public licen[sc]e;gnu gpl | gpl | 1.0 2.0 3.0
lgpl | gnu (lesser|library) general public licen[sc]e;(lesser|library) general public licen[sc]e;gnu lgpl | lgpl | 2.0 2.1 3.0
agpl | gnu affero general public licen[sc]e;affero general public licen[sc]e;gnu agpl | agpl | 1.0 3.0
gfdl | gnu free documentation licen[sc]e;free documentation licen[sc]e | gfdl | 1.1 1.2 1.3
apache | apache( software)? licen[sc]e | apache | 1.0 1.1 2.0
mit | mit licen[sc]e;expat licen[sc]e;x11 licen[sc]e | mit |
mit-0 | mit no attribution( licen[sc]e)? | mit 0 |
bsd | bsd( style)? licen[sc]e;berkeley software distribution licen[sc]e | bsd |
bsd-2-clause | (2|two) clause bsd( licen[sc]e)?;simplified bsd licen[sc]e;freebsd licen[sc]e;bsd 2 clause | bsd 2 clause |
bsd-3-clause | (3|three) clause bsd( licen[sc]e)?;(new|modified|revised) bsd licen[sc]e;bsd 3 clause | bsd 3 clause |
bsd-4-clause | (4|four) clause bsd( licen[sc]e)?;(original|old) bsd licen[sc]e;bsd 4 clause | bsd 4 clause |
0bsd | zero clause bsd( licen[sc]e)?;bsd zero clause licen[sc]e | 0bsd |
isc | isc licen[sc]e | isc |
mpl | mozilla public licen[sc]e | mpl | 1.0 1.1 2.0
epl | eclipse public licen[sc]e | epl | 1.0 2.0
edl | eclipse distribution licen[sc]e | edl | 1.0
cddl | common development and distribution licen[sc]e | cddl | 1.0 1.1
cpl | common public licen[sc]e | cpl | 1.0
ipl | ibm public licen[sc]e | ipl | 1.0
eupl | european union public licen[sc]e | eupl | 1.0 1.1 1.2
cecill | cecill( free software)? licen[sc]e( agreement)? | cecill | 1.0 2.0 2.1
artistic | artistic licen[sc]e;perl artistic licen[sc]e | artistic | 1.0 2.0
python | python software foundation licen[sc]e;psf licen[sc]e | psf | 2.0
ruby | ruby licen[sc]e | ruby |
php | php licen[sc]e | php | 3.0 3.01
zlib | zlib( libpng)? licen[sc]e | zlib |
libpng | libpng licen[sc]e | libpng | 2.0
openssl | openssl licen[sc]e | openssl |
curl | curl licen[sc]e | curl |
boost | boost software licen[sc]e | bsl | 1.0
unlicense | the unlicense | unlicense |
wtfpl | do what the fuck you want to public licen[sc]e | wtfpl | 2
beerware | beer ?ware licen[sc]e | beerware |
cc0 | creative commons (zero|cc0);cc0( licen[sc]e)? | cc0 | 1.0
cc-by | creative commons attribution( licen[sc]e)?;cc by | cc by | 1.0 2.0 2.5 3.0 4.0
cc-by-sa | creative commons attribution share ?alike( licen[sc]e)?;cc by sa | cc by sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nd | creative commons attribution no ?deriv(ative)?s( licen[sc]e)?;cc by nd | cc by nd | 1.0 2.0 2.5 3.0 4.0
cc-by-nc | creative commons attribution non ?commercial( licen[sc]e)?;cc by nc | cc by nc | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike( licen[sc]e)?;cc by nc sa | cc by nc sa | 1.0 2.0 2.5 3.0 4.0
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(ative)?s( licen[sc]e)?;cc by nc nd | cc by nc nd | 1.0 2.0 2.5 3.0 4.0
pddl | public domain dedication and licen[sc]e | pddl | 1.0
odc-by | open data commons attribution licen[sc]e | odc by | 1.0
odbl | open database licen[sc]e | odbl | 1.0
ofl | (sil )?open font licen[sc]e | ofl | 1.0 1.1
ms-pl | microsoft public licen[sc]e | ms pl |
ms-rl | microsoft reciprocal licen[sc]e | ms rl |
apsl | apple public source licen[sc]e | apsl | 1.0 2.0
qpl | q public licen[sc]e | qpl | 1.0
spl | sun public licen[sc]e | spl | 1.0
sspl | server side public licen[sc]e | sspl | 1.0
busl | business source licen[sc]e | busl | 1.1
elastic | elastic licen[sc]e | elastic | 2.0
postgresql | postgresql licen[sc]e | postgresql |
ncsa | (university of illinois )?ncsa( open source)? licen[sc]e | ncsa |
w3c | w3c( software)?( notice and)? licen[sc]e | w3c |
zope | zope public licen[sc]e | zpl | 1.1 2.0 2.1
upl | universal permissive licen[sc]e | upl | 1.0
afl | academic free licen[sc]e | afl | 1.1 2.0 2.1 3.0
osl | open software licen[sc]e | osl | 1.0 2.0 2.1 3.0
ecl | educational community licen[sc]e | ecl | 1.0 2.0
rpl | reciprocal public licen[sc]e | rpl | 1.1 1.5
nosl | netizen open source licen[sc]e | nosl |
lppl | latex project public licen[sc]e | lppl | 1.0 1.1 1.2 1.3
mulan | mulan( permissive software| psl)? licen[sc]e | mulanpsl | 1.0 2.0
openldap | openldap public licen[sc]e | oldap | 2.8
blueoak | blue oak model licen[sc]e | blueoak | 1.0.0
bigcode-openrail-m | (bigscience|bigcode) open ?rail m( licen[sc]e)? | openrail |
llama | llama( 2| 3)? community licen[sc]e | llama |
""".strip()

#: Sentences of license texts and plain notices: label, priority, keyword, words.
SENTENCES = [
    ("mit", NOTICE, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", NOTICE, "permission", "permission to use copy modify and( or)? distribute this software for any purpose"),
    ("bsd", NOTICE, "redistribution", "redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", NOTICE, "neither", "neither the name of"),
    ("gpl", NOTICE, "redistribute", "this program is free software you can redistribute it"),
    ("lgpl", NOTICE, "redistribute", "this library is free software you can redistribute it"),
    ("apache-2.0", TAG, "apache", "www apache org licen[sc]es licen[sc]e 2 0"),
    ("cc", MENTION, "creativecommons", "creativecommons org licenses"),
    ("cc0-1.0", TAG, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("gpl", TITLE, "gnu", "www gnu org licenses"),
    ("unlicense", NOTICE, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", TITLE, "domain", "(in|into|to) the public domain"),
    ("zlib", NOTICE, "implied", "this software is provided as is without any express or implied warranty"),
    ("no-warranty", MENTION, "warrant", "without (any )?(express or implied )?warrant(y|ies)"),
    ("proprietary", TITLE, "reserved", "all rights reserved"),
    ("proprietary", NOTICE, "confidential", "proprietary and confidential"),
    ("copyright", MENTION, "copyright", "copyright"),
    ("free-use", MENTION, "freely", "may be freely (used|copied|distributed|shared)"),
    ("non-commercial", MENTION, "commercial", "(not for|no|non) commercial use"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern


def _compiled(words: str) -> re.Pattern:
    """Words with gaps between them; " ?" is a gap that may be absent."""
    body = words.replace(" ?", "\1").replace(" ", "\0").encode().replace(b"\1", rb"(?:" + _GAP + rb")?").replace(b"\0", _GAP)
    return re.compile(rb"(?<![" + _WORD + rb"])(?:" + body + rb")(?![" + _WORD + rb"])")


def _keyword(words: str) -> str:
    """The longest literal word of a name; every match holds it."""
    plain = re.sub(r"\([^()]*\)\?", " ", words)
    plain = re.sub(r"\S*\([^()]*\)\S*", " ", plain)
    return max((w for w in plain.split() if re.fullmatch("[a-z0-9]+", w)), key=len, default="licen")


def build_rules(signatures: str = SIGNATURES) -> list[Rule]:
    """All rules in order: sentences first, then the forms of every signature."""
    rules = [Rule(label, level, key.encode(), _compiled(words)) for label, level, key, words in SENTENCES]
    given = r"(licen[sc]ed|released|distributed|published|available|provided|redistributed|covered) (under|by)( the)?( terms( and conditions)? of( the)?)?"
    for line in signatures.splitlines():
        label, names, tags, versions = (x.strip() for x in _fields(line))
        name_list, numbers = names.split(";"), versions.split()
        for name in name_list:
            key = _keyword(name).encode()
            rules.append(Rule(label, TITLE, key, _compiled(name)))
            rules.append(Rule(label, NOTICE, key, _compiled(f"{given} {name}")))
            for v in numbers:
                number = v.removesuffix(".0").replace(".", " ")
                number += "( 0)?" if v.endswith(".0") else ""
                rules.append(Rule(f"{label}-{v}", VERSION, key, _compiled(f"{name}( (unported|international|generic))? (version |v )?v?{number}")))
                rules.append(Rule(f"{label}-{v}", NOTICE, key, _compiled(f"{given} {name} (version |v )?v?{number}")))
        key = b"spdx"
        rules.append(Rule(label, TAG, key, _compiled(f"spdx licen[sc]e identifier {tags}")))
        for v in numbers:
            rules.append(Rule(f"{label}-{v}", TAG, key, _compiled(f"spdx licen[sc]e identifier {tags} {v.replace('.', ' ')}( (only|or later))?")))
    return rules


def _fields(line: str) -> tuple[str, str, str, str]:
    """Label, names, tags and versions of a signature line; "|" inside brackets belongs to a name."""
    label, rest = line.split("|", 1)
    names, tags, versions = rest.rsplit("|", 2)
    return label, names, tags, versions


def survivors(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (start, end, priority, label) that no other one suppresses.

    One is suppressed by an interval that contains it and has a higher priority,
    or the same priority and more length.  Equal intervals of one priority stay
    with their first rule's label, the order in which they were found.
    """
    levels: dict[int, tuple[list[int], list[int]]] = {}
    out = []
    for priority in sorted({f[2] for f in found}, reverse=True):
        starts, tops, top = [], [], -1
        for start, end, _, label in sorted((f for f in found if f[2] == priority), key=lambda f: (f[0], -f[1])):
            if end <= top:
                continue  # inside one that began no later, of this priority
            hidden = False
            for begins, ends in levels.values():
                k = bisect_right(begins, start)
                hidden |= k > 0 and ends[k - 1] >= end
            starts.append(start)
            tops.append(top := end)
            if not hidden:
                out.append((start, end, priority, label))
        levels[priority] = (starts, tops)
    return sorted(out)


class Scanner:
    """All rules, gated by one automaton over their keywords."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = build_rules() if rules is None else rules
        self.base = [(label, _compiled(phrase)) for phrase, label in BASE.items()]
        by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_word.setdefault(rule.keyword.decode("latin-1"), []).append(i)
        for k, phrase in enumerate(BASE):
            by_word.setdefault(max(phrase.split(), key=len), []).append(-1 - k)
        self.automaton = ahocorasick.Automaton()
        for word, which in by_word.items():
            self.automaton.add_word(word, which)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        low = text.encode().lower()
        words = low.translate(_SPLIT)
        n_words = len(words.split())
        due = sorted({i for _, which in self.automaton.iter(low.decode("latin-1")) for i in which})
        places, base, found = [], set(), []
        for i in due:
            if i < 0:
                label, pattern = self.base[-1 - i]
                at = [m.start() for m in pattern.finditer(low)]
                places += at
                base |= {label} if at else set()
            else:
                rule = self.rules[i]
                found += [(m.start(), m.end(), rule.priority, rule.label) for m in rule.pattern.finditer(low)]
        kept = survivors(found)
        labels = base | {f[3] for f in kept}
        score = max([CONFIDENCE[f[2]] for f in kept] + [CONFIDENCE[TITLE]] * bool(base), default=0.0)
        first = last = None
        if places:
            lo, hi = min(places), max(places)
            first = len(words[:lo].split())
            last = first + len(words[lo:hi].split())
        return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_SCANNERS: list[Scanner] = []


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document.

    The rules run on the bytes of the text with A-Z in lower case.  A keyword
    automaton decides which rules run at all; detections inside a stronger or
    longer detection are suppressed; the places and labels of the base phrases
    always stay.  The score is the confidence of the strongest surviving rule.

    Cases: a null or empty text has no words, no labels ('') and score 0; the whole
    of a long text is scanned; repeated rows give a row each; an empty table gives
    an empty result.
    """
    rows = docs.select(col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        for batch in batches:
            if batch.num_rows:
                made = zip(*[_SCANNERS[0].scan(t.as_py()) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(made, kinds)]], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
