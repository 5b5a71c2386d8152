"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: The phrases whose places are counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WORD = rb"[0-9a-z\x80-\xff]"
GAP = rb"[^0-9a-z\x80-\xff]+"
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True


class Rule(NamedTuple):
    label: str
    priority: int  # smaller goes first
    keyword: bytes  # must occur in a text that the pattern can match
    pattern: re.Pattern[bytes]
    base: bool = False


def _pattern(source: str) -> re.Pattern[bytes]:
    """A space in the source stands for any run of other than word characters, " ?" for one or none."""
    inner = source.encode().replace(b" ?", rb"(?:" + GAP + rb")?").replace(b" ", GAP)
    return re.compile(rb"(?<!" + WORD + rb")(?:" + inner + rb")(?!" + WORD + rb")")


#: Priorities: machine-readable tags, full names with versions, names without, permissions, mentions.
TAG, VERSIONED, NAMED, GRANT, MENTION = 10, 20, 30, 40, 50
_NUMBER = r"(?:v|ver|version)? ?"
_UNDER = r"(?:licensed|released|distributed|published|provided|available|covered) under(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"
_LICENSE = r"licen[cs]e"

#: Hand-written families: label stem, keyword, name, versions, abbreviation, whether "or later" matters.
FAMILIES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "1 2 3", "gpl", True),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", "2 2.1 3", "lgpl", True),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", "2 2.1", "", True),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "1 3", "agpl", True),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "1.1 1.2 1.3", "gfdl", True),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "1.0 1.1 2", "", False),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e", "1.0 1.1 2", "mpl", False),
    ("epl", "eclipse public", r"eclipse public licen[cs]e", "1 2", "epl", False),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e", "1", "", False),
    ("cpl", "common public", r"common public licen[cs]e", "1", "", False),
    ("cpal", "common public attribution", r"common public attribution licen[cs]e", "1", "cpal", False),
    ("ipl", "ibm public", r"ibm public licen[cs]e", "1", "", False),
    ("cddl", "development and distribution", r"common development and distribution licen[cs]e", "1.0 1.1", "cddl", False),
    ("artistic", "artistic", r"artistic licen[cs]e", "1 2", "", False),
    ("bsl", "boost software", r"boost software licen[cs]e", "1", "", False),
    ("eupl", "european union public", r"european union public licen[cs]e", "1.0 1.1 1.2", "eupl", False),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "1.0 1.1", "", False),
    ("osl", "open software", r"open software licen[cs]e", "1.0 1.1 2.0 2.1 3", "osl", False),
    ("afl", "academic free", r"academic free licen[cs]e", "1.1 1.2 2.0 2.1 3", "afl", False),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", "1.0 1.1 2.0 2.1", "", False),
    ("odbl", "open database", r"open database licen[cs]e", "1", "odbl", False),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[cs]e", "1", "", False),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "", "", False),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "", "", False),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "1", "", False),
    ("psf", "python software foundation", r"python software foundation licen[cs]e", "2", "", False),
    ("php", "php licen", r"php licen[cs]e", "3.0 3.01", "", False),
    ("zpl", "zope public", r"zope public licen[cs]e", "1.1 2.0 2.1", "zpl", False),
    ("qpl", "q public", r"q public licen[cs]e", "1", "", False),
    ("sspl", "server side public", r"server side public licen[cs]e", "1", "sspl", False),
    ("busl", "business source", r"business source licen[cs]e", "1.0 1.1", "busl", False),
    ("elastic", "elastic licen", r"elastic licen[cs]e", "1 2", "", False),
    ("lppl", "latex project public", r"latex project public licen[cs]e", "1.0 1.1 1.2 1.3", "lppl", False),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "", "", False),
    ("mulan", "mulan", r"mulan (?:permissive|public)(?: software)? licen[cs]e", "1 2", "", False),
    ("apsl", "apple public", r"apple public source licen[cs]e", "1.0 1.1 1.2 2", "apsl", False),
    ("nasa", "nasa open", r"nasa open source agreement", "1.3", "", False),
    ("rpl", "reciprocal public", r"reciprocal public licen[cs]e", "1.1 1.5", "", False),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", "", "", False),
    ("spl", "sun public", r"sun public licen[cs]e", "1", "", False),
    ("npl", "netscape public", r"netscape public licen[cs]e", "1.0 1.1", "", False),
    ("w3c", "w3c", r"w3c (?:software|document)(?: notice and)? licen[cs]e", "", "", False),
    ("unicode", "unicode", r"unicode(?: data files and software)? licen[cs]e", "", "", False),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e", "1", "", False),
    ("parity", "parity public", r"parity public licen[cs]e", "6.0 7.0", "", False),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|small business|perimeter|free trial|internal use) licen[cs]e", "1", "", False),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?", "1", "", False),
    ("hippocratic", "hippocratic", r"hippocratic licen[cs]e", "1.2 2.0 2.1 3", "", False),
    ("free-art", "free art", r"free art licen[cs]e", "1.2 1.3", "", False),
    ("rail", "responsible", r"responsible ai licen[cs]e", "", "", False),
    ("openrail", "openrail", r"(?:bigscience |bigcode |creativeml )?openrail(?: [m+]{1,2})?(?: licen[cs]e)?", "", "", False),
    ("vim", "vim licen", r"vim licen[cs]e", "", "", False),
    ("ruby", "ruby licen", r"ruby licen[cs]e", "", "", False),
    ("openssl", "openssl", r"openssl licen[cs]e", "", "", False),
    ("isc", "isc licen", r"isc licen[cs]e", "", "", False),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "", "", False),
    ("x11", "x11 licen", r"x11 licen[cs]e", "", "", False),
    ("mit", "mit", r"mit(?: x11| expat)? licen[cs]e", "", "", False),
    ("mit", "expat", r"expat licen[cs]e", "", "", False),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e", "", "", False),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "", "", False),
    ("wtfpl", "want to public", r"do what the (?:f\w+|hell) you want to public licen[cs]e", "2", "wtfpl", False),
    ("beerware", "beer", r"beer ?ware(?: licen[cs]e)?", "", "", False),
    ("json", "json licen", r"json licen[cs]e", "", "", False),
    ("bsd-2-clause", "bsd", r"(?:simplified|two clause|2 clause|freebsd) bsd licen[cs]e|bsd (?:two|2) clause(?: licen[cs]e)?", "", "", False),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|three clause|3 clause) bsd licen[cs]e|bsd (?:three|3) clause(?: licen[cs]e)?", "", "", False),
    ("bsd-4-clause", "bsd", r"(?:original|old|four clause|4 clause) bsd licen[cs]e|bsd (?:four|4) clause(?: licen[cs]e)?", "", "", False),
    ("0bsd", "bsd", r"(?:zero clause|0 clause|free public) bsd(?: licen[cs]e)?|0bsd", "", "", False),
    ("bsd", "bsd", r"bsd(?: style| type)? licen[cs]e", "", "", False),
    ("odc-pddl", "public domain dedication", r"(?:odc )?public domain dedication and licen[cs]e", "1", "pddl", False),
    ("ogl", "open government", r"open government licen[cs]e", "1 2 3", "", False),
    ("etalab", "ouverte", r"licence ouverte(?: etalab)?", "1 2", "", False),
    ("etalab", "etalab", r"etalab open licen[cs]e", "1 2", "", False),
    ("proprietary", "all rights reserved", r"all rights reserved", "", "", False),
)
#: Creative Commons: element codes and their spelled-out names.
COMMONS = (
    ("cc-by", "by", r"attribution"),
    ("cc-by-sa", "by sa", r"attribution share ?alike"),
    ("cc-by-nd", "by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc", r"attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_WARRANTY = r"(?:software|program|work|library|material|documentation) is provided as is"
#: Grants, conditions and warranties: label, keyword, pattern.
GRANTS = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"(?:names?|name of the copyright holder) (?:of its contributors |of the copyright holder )?may (?:not )?be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such"),
    ("gpl", "free software", r"this program is free software you can redistribute it"),
    ("gpl", "fitness for a particular", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("lgpl", "this library is free", r"this library is free software you can redistribute it"),
    ("gpl-exception", "special exception", r"as a special exception(?: [a-z0-9]+){0,12} link(?:ing)?"),
    ("gpl-exception", "linking exception", r"linking exception"),
    ("gpl-classpath", "classpath", r"classpath exception"),
    ("gpl-runtime", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-autoconf", "autoconf", r"autoconf (?:configure script )?exception"),
    ("gpl-bison", "bison", r"bison exception"),
    ("llvm-exception", "llvm", r"llvm exceptions?"),
    ("apache", "in compliance with", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache", "without warranties or", r"without warranties or conditions of any kind either express or implied"),
    ("apache", "perpetual", r"a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e"),
    ("mpl", "this source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", "incompatible with secondary", r"incompatible with secondary licen[cs]es"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under"),
    ("bsl", "boost org", r"(?:www )?boost org licen[cs]e 1 0 txt"),
    ("bsl", "accompanying file", r"see accompanying file licen[cs]e 1 0 txt"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "no copyright", r"no copyright(?: reserved)? public domain"),
    ("cc0", "waived all copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed) (?:in ?to|in|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain", "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("public-domain", "public domain", r"public domain mark(?: 1 0)?"),
    ("unlicense", "unencumbered", r"(?:is )?free and unencumbered software(?: released into the public domain)?"),
    ("wtfpl", "what the", r"you just do what the (?:f\w+|hell) you want to"),
    ("beerware", "beer in return", r"you can buy me a beer in return"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("ofl", "reserved font", r"with reserved font names?"),
    ("ofl", "sil org", r"scripts sil org ofl"),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: itself)?"),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium"),
    ("ntp", "without fee", r"for any purpose with or without fee is hereby granted"),
    ("hpnd", "without fee", r"for any purpose and without fee is hereby granted"),
    ("non-commercial", "commercial", r"for non ?commercial(?: use| purposes)?(?: only)?"),
    ("non-commercial", "commercial use", r"commercial use (?:is )?(?:not (?:permitted|allowed)|prohibited)"),
    ("non-commercial", "only", r"for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only"),
    ("personal-use", "personal", r"for personal(?: non ?commercial)? use only"),
    ("evaluation", "evaluation", r"for evaluation(?: purposes| use)? only"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))?(?: of this (?:file|work|document|material))?(?: via any medium)?(?: is)? (?:strictly )?prohibited"),
    ("proprietary", "permission of", r"without (?:the )?(?:prior )?(?:express )?(?:written )?permission of"),
    ("proprietary", "consent of", r"without (?:the )?(?:prior )?(?:express )?(?:written )?consent of"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?: stored| copied| or transmitted| distributed)*"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work) may be"),
    ("proprietary", "trade secret", r"trade secrets? (?:of|and)"),
    ("proprietary", "end user licen", r"end user licen[cs]e agreement"),
    ("proprietary", "internal use only", r"for internal use only"),
    ("warranty", "provided as is", rf"(?:this|the) {_WARRANTY}(?: without warrant(?:y|ies) of any kind)?"),
    ("warranty", "no warranty", r"(?:there is|comes with|with) (?:absolutely )?no warranty"),
    ("warranty", "in no event", r"in no event (?:shall|will) the (?:authors?|copyright (?:holders?|owners?)|regents|contributors)(?: or (?:copyright holders?|contributors|authors))? be liable"),
    ("dual", "dual", r"dual(?:ly)? licen[cs]ed?"),
)


def _version(text: str) -> str:
    """How a version is spelled: a zero after a whole number may be left out."""
    return text.replace(".", " ") if "." in text else f"{text}(?: 0)?"


def rules() -> tuple[Rule, ...]:
    """All signature rules in order: of detections with the same span and priority the earlier rule's stays."""
    found = [Rule(label, 0, phrase.split()[-1].encode(), _pattern(phrase), True) for phrase, label in BASE]
    later = r"(?: or(?: at your option)?(?: any)? later(?: version)?|\+)"

    def add(label: str, priority: int, keyword: str, pattern: str) -> None:
        found.append(Rule(label, priority, keyword.encode(), _pattern(pattern)))

    for stem, keyword, name, versions, short, or_later in FAMILIES:
        tag = f"spdx license identifier {stem.replace('-', ' ')}"
        for v in versions.split():
            label = f"{stem}-{v}" if "." in v or stem.endswith(("gpl", "mulan")) else f"{stem}-{v}.0"
            number = _version(v)
            ways = [(keyword, f"(?:{_UNDER} )?(?:{name})(?: the)? {_NUMBER}{number}(?: of the(?: gnu)? licen[cs]e)?", VERSIONED), ("identifier", f"{tag} {number}", TAG)]
            if short:
                ways.append((short, f"(?:gnu )?{short}(?: licen[cs]e)? ?{_NUMBER}{number}", VERSIONED + 3))
            for key, pattern, priority in ways:
                if or_later:
                    add(f"{label}-or-later", priority, key, pattern + later)
                    add(f"{label}-only", priority + 1, key, f"{pattern} only")
                add(label, priority + 2, key, pattern)
        add(stem, NAMED, keyword, f"(?:{_UNDER} )?(?:{name})")
        if not versions:
            add(stem, TAG, "identifier", tag)
    for label, code, name in COMMONS:
        for v in COMMONS_VERSIONS:
            n = _version(v)
            add(f"{label}-{v}", VERSIONED, "cc", f"(?:{_UNDER} )?cc {code} {n}")
            add(f"{label}-{v}", VERSIONED, "commons", f"(?:{_UNDER} )?creative commons {name}(?: licen[cs]e)? {n}(?: international| unported| generic)?")
            add(f"{label}-{v}", VERSIONED, "attribution", f"{name}(?: licen[cs]e)? {n} (?:international|unported|generic)")
            add(f"{label}-{v}", TAG, "creativecommons", f"creativecommons org licenses {code} {n}")
            add(f"{label}-{v}", TAG, "identifier", f"spdx license identifier cc {code} {n}")
        add(label, NAMED, "cc", f"(?:{_UNDER} )?cc {code}")
        add(label, NAMED, "commons", f"(?:{_UNDER} )?creative commons {name}")
    for label, keyword, pattern in GRANTS:
        add(label, GRANT, keyword, pattern)
    add("unspecified", MENTION, "licensed under", r"licensed under(?: the)?(?: terms(?: and conditions)? of)?(?: the)?")
    add("unspecified", MENTION, "licen", rf"(?:released|distributed|published|provided|available|covered) under(?: the)?(?: terms(?: and conditions)? of)?(?: (?:the|an|a|this|its))?(?: [a-z0-9]+)?(?: [a-z0-9]+)?(?: [a-z0-9]+)? {_LICENSE}")
    add("copyright", MENTION, "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}")
    return tuple(found)


class Hit(NamedTuple):
    start: int
    end: int
    rule: int


def suppress(hits: list[Hit], order: tuple[Rule, ...]) -> list[Hit]:
    """Without hits whose span lies in that of a hit of the same or a better priority (of equal spans and
    priorities the earlier rule's stays).  Base hits stay and suppress nothing.  One sweep: a hit that
    suppresses another needn't itself survive, as what suppresses it suppresses the other too."""
    levels = sorted({r.priority for r in order})
    reach, kept = dict.fromkeys(levels, -1), []
    for h in sorted(hits, key=lambda h: (h.start, -h.end, order[h.rule].priority, h.rule)):
        own = order[h.rule]
        if own.base:
            kept.append(h)
        elif max(reach[p] for p in levels if p <= own.priority) < h.end:
            kept.append(h)
        if not own.base:
            reach[own.priority] = max(reach[own.priority], h.end)
    return kept


#: Everything but word characters becomes a space.
_PLAIN = bytes(b if _IS_WORD[b] else 0x20 for b in range(256))


class Scanner:
    def __init__(self, order: tuple[Rule, ...]):
        self.order = order
        self.by_keyword: dict[bytes, list[int]] = {}
        for k, r in enumerate(order):
            self.by_keyword.setdefault(r.keyword, []).append(k)
        self.keywords = ahocorasick.Automaton()
        for w in self.by_keyword:
            self.keywords.add_word(w.decode("latin-1"), w)
        self.keywords.make_automaton()

    def __call__(self, text: bytes) -> tuple[int, list[Hit], np.ndarray | None]:
        """Words, detections that stay, and the word index at each byte (None without detections)."""
        text = text.lower()
        words = text.translate(_PLAIN).split()
        # A keyword's space stands for any gap, so keywords are looked for in text of single spaces.
        seen = {w for _, w in self.keywords.iter(b" ".join(words).decode("latin-1"))}
        hits = [Hit(m.start(), m.end(), k) for w in seen for k in self.by_keyword[w] for m in self.order[k].pattern.finditer(text)]
        if not hits:
            return len(words), [], None
        word = _IS_WORD[np.frombuffer(text, dtype=np.uint8)]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        return len(words), suppress(hits, self.order), np.cumsum(begins)


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("priority", T.IntegerType()), T.StructField("base", T.BooleanType())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, covered (words within a span) and spans, an array of
    (label, first_word, last_word, priority, base) in the order of their places.

    Texts are lower-cased in A-Z; words are runs of digits, a-z and characters above U+007F, numbered from
    0.  Null and empty texts have no words and no spans.  Repeated rows are scanned alike; other columns
    are ignored.  Nothing depends on other rows."""
    small_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules())
        kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            n_words, covered, spans = [], [], []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                n, hits, index = scanner(text or b"")
                out, upto, cover = [], -1, 0
                for h in sorted(hits, key=lambda h: (h.start, h.end, h.rule)):
                    first, last, own = int(index[h.start]) - 1, int(index[h.end - 1]) - 1, scanner.order[h.rule]
                    cover += max(0, last - max(first, upto + 1) + 1)
                    upto = max(upto, last)
                    out.append({"label": own.label, "first_word": first, "last_word": last, "priority": own.priority, "base": own.base})
                n_words.append(n)
                covered.append(cover)
                spans.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(covered, pa.int64()), pa.array(spans, kind)], names=schema.names)

    return slim.mapInArrow(run, schema)
