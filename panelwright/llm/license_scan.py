"""License scans: ordered signature rules behind a keyword prefilter, with overlapping detections resolved by priority and containment.

Only DataFrame and SQL functions run here; every row is decided by itself, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label | keywords, one of which is in every match | signature over words that single spaces join. The order is the rules' order within a priority.
NAMES = """
apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
apache-2.0 | apache | apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?
apache-any | apache | apache (?:software )?licen[sc]e
mit-0 | attribution | mit no attribution(?: license)?
mit | mit expat | (?:mit|expat) licen[sc]e
mit-x11 | x11 | (?:mit )?x11 license
mit-text | permission | permission is hereby granted free of charge to any person obtaining a copy
mit-cmu | cmu | cmu license
isc | isc | isc licen[sc]e
isc-text | permission | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee
bsd-0 | bsd | (?:0bsd|(?:0|zero) clause bsd)(?: license)?
bsd-1 | bsd | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-2 | bsd | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3 | bsd | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: license)?
bsd-4 | bsd | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: license)?
bsd-3-lbnl | lbnl | (?:bsd 3 clause )?lbnl(?: bsd)? license
bsd-any | bsd | bsd(?: style)? licen[sc]e
bsd-text | redistribution | redistribution and use in source and binary forms with or without modification are permitted
gpl-1.0 | general | (?:gnu )?general public license (?:version |v)?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public license (?:version |v)?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public license (?:version |v)?3(?: 0)?
gpl-any | general | (?:gnu )?general public licen[sc]e
gpl-2.0-short | gpl | (?:gnu )?gpl (?:version |v)?2(?: 0)?(?: only| or later)?
gpl-3.0-short | gpl | (?:gnu )?gpl (?:version |v)?3(?: 0)?(?: only| or later)?
gplv2 | gplv2 | gplv2(?: or later)?
gplv3 | gplv3 | gplv3(?: or later)?
gpl-short | gpl | (?:gnu )?gpl(?: license)?
lgpl-2.0 | library | (?:gnu )?library general public license (?:version |v)?2(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license (?:version |v)?2 1
lgpl-3.0 | lesser | (?:gnu )?lesser general public license (?:version |v)?3(?: 0)?
lgpl-any | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl-2.1-short | lgpl | (?:gnu )?lgpl (?:version |v)?2 1(?: only| or later)?
lgpl-3.0-short | lgpl | (?:gnu )?lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-short | lgpl | (?:gnu )?lgpl
agpl-1.0 | affero | affero general public license (?:version |v)?1(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public license(?: (?:version |v)?3(?: 0)?)?
agpl-short | agpl | (?:gnu )?agpl(?: (?:version |v)?3(?: 0)?)?(?: only| or later)?
gfdl-1.1 | documentation | (?:gnu )?free documentation license (?:version |v)?1 1
gfdl-1.2 | documentation | (?:gnu )?free documentation license (?:version |v)?1 2
gfdl-1.3 | documentation | (?:gnu )?free documentation license (?:version |v)?1 3
gfdl-any | documentation | (?:gnu )?free documentation license
mpl-1.0 | mozilla | mozilla public license (?:version |v)?1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v)?1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v)?2(?: 0)?
mpl-any | mozilla | mozilla public licen[sc]e
mpl-short | mpl | mpl (?:version |v)?(?:1 0|1 1|2 0)
epl-1.0 | eclipse | eclipse public license (?:version |v)?1(?: 0)?
epl-2.0 | eclipse | eclipse public license (?:version |v)?2(?: 0)?
epl-any | eclipse | eclipse public licen[sc]e
epl-short | epl | epl (?:version |v)?(?:1|2) 0
edl-1.0 | eclipse | eclipse distribution license(?: (?:version |v)?1 0)?
cddl-1.0 | distribution | common development and distribution license (?:version |v)?1 0
cddl-any | distribution | common development and distribution license
cddl-short | cddl | cddl (?:version |v)?1 [01]
cpl-1.0 | common | common public license(?: (?:version |v)?1 0)?
eupl-1.1 | european | european union public licen[sc]e (?:version |v)?1 1
eupl-1.2 | european | european union public licen[sc]e (?:version |v)?1 2
eupl-any | european | european union public licen[sc]e
eupl-short | eupl | eupl (?:version |v)?1 [12]
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.0 | cc | cc by 2 [05]
cc-by-sa-4.0 | cc | cc by sa 4 0
cc-by-sa-3.0 | cc | cc by sa 3 0
cc-by-sa-2.0 | cc | cc by sa 2 [05]
cc-by-nc-4.0 | cc | cc by nc 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0
cc-by-nd-4.0 | cc | cc by nd 4 0
cc-by-nd-3.0 | cc | cc by nd 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
cc-by-any | cc | cc by(?: nc| sa| nd)*
cc-by-name | commons | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa-name | commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-name | commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nd-name | commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa-name | commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-nd-name | commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-any | commons | creative commons licen[sc]e
unlicense | unlicense | (?:the )?unlicense
unlicense-text | unencumbered | this is free and unencumbered software released into the public domain
public-domain | domain | (?:released |placed |dedicated )?(?:in|into|to) the public domain
wtfpl | wtfpl | wtfpl(?: (?:version |v)?2)?
wtfpl-name | what | do what the fuck you want to public license
zlib | zlib | zlib(?: libpng)?(?: license)?
libpng | libpng | libpng license(?: (?:version |v)?2)?
boost | boost | boost software license(?: (?:version |v)?1 0)?
boost-short | bsl | bsl 1 0
busl-1.1 | business | business source license(?: (?:version |v)?1 1)?
artistic-1.0 | artistic | artistic license (?:version |v)?1(?: 0)?
artistic-2.0 | artistic | artistic license (?:version |v)?2(?: 0)?
artistic-any | artistic | artistic licen[sc]e
perl | perl | same terms as perl(?: itself)?
python-2.0 | python psf | (?:python|psf) (?:software foundation )?license(?: (?:version |v)?2)?
php-3.01 | php | php license(?: (?:version |v)?3(?: 0?1)?)?
ruby | ruby | ruby license
postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl license
w3c | w3c | w3c (?:software )?(?:notice and )?license
ofl-1.1 | font | (?:sil )?open font license(?: (?:version |v)?1 1)?
ofl-short | ofl | (?:sil )?ofl 1 1
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
afl-3.0 | academic | academic free license(?: (?:version |v)?(?:1|2|3) [0-9])?
osl-3.0 | open | open software license(?: (?:version |v)?(?:1|2|3) [0-9])?
odbl-1.0 | database | open (?:data commons open )?database license(?: (?:version |v)?1 0)?
odc-by-1.0 | commons | open data commons attribution license(?: (?:version |v)?1 0)?
pddl-1.0 | dedication | public domain dedication and license(?: (?:version |v)?1 0)?
upl-1.0 | universal | universal permissive license(?: (?:version |v)?1 0)?
vim | vim | vim license
beerware | beerware | beerware(?: license)?
sspl-1.0 | server | server side public license(?: (?:version |v)?1)?
elastic-2.0 | elastic | elastic license(?: (?:version |v)?2(?: 0)?)?
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: license)?
llama-community | llama | llama (?:[23](?: [0-9])? )?community license
proprietary | proprietary | proprietary(?: and confidential| license)?
all-rights-reserved | reserved | all rights reserved
"""
GRANT = r"(?:(?:re)?licensed|released|distributed|available|published|provided|covered|governed|issued) (?:under|by)(?: the)?(?: terms of)?(?: the)? "
IDENTIFIER = r"spdx license identifier "
#: priority, confidence, what stands before the signature.
FORMS = ((1, 1.0, IDENTIFIER), (2, 0.9, GRANT), (3, 0.6, ""))


#: Prefilter over whole texts: a text without any of these substrings is not searched further. All but the last two lines come with nearly
#: every rule's own words. Each is part of one word, as anything but words may part two; CC_BY is asked for by a pattern of its own.
HINTS = (
    "licen", "spdx", "apache", "gpl", "bsd", "cc0", "commons", "domain", "reserved", "proprietary", "hereby", "permission",
    "redistribution", "unencumbered", "wtfpl", "zlib", "cddl", "eupl", "beerware", "openrail", "perl", "fuck",
    "mpl", "epl", "ofl", "bsl", "attribution",
)
CC_BY = f"cc{BETWEEN_WORDS}by"


def rules() -> list[tuple[str, str, int, int, float, str]]:
    """label, keywords, priority, order, confidence, regex: each signature in each form."""
    names = [[x.strip() for x in line.split(" | ")] for line in NAMES.strip().splitlines()]
    return [(label, key, p, i, sure, f"(?<= ){before}(?:{rx})(?= )") for i, (label, key, rx) in enumerate(names) for p, sure, before in FORMS]


def _literal(text: str) -> str:
    return "r'" + text + "'"


def _rules_by_keyword() -> tuple[str, list[str]]:
    keys: dict[str, list[str]] = {}
    for label, key, p, i, sure, rx in rules():
        for k in key.split():
            keys.setdefault(k, []).append(f"named_struct('label', '{label}', 'prio', {p}, 'nr', {i}, 'sure', {sure}D, 'rx', {_literal(rx)})")
    return "map(" + ", ".join(f"'{k}', array({', '.join(v)})" for k, v in keys.items()) + ")", list(keys)


#: Words from first to last of each match of rx in the words t: what stands between matches, and the matches, alternate.
_SPANS = """aggregate(
  zip_with(slice(split({t}, {rx}, -1), 1, size(regexp_extract_all({t}, {rx}, 0))), regexp_extract_all({t}, {rx}, 0),
    (p, m) -> named_struct('p', cast(length(p) - length(replace(p, ' ', '')) as bigint), 'm', cast(length(m) - length(replace(m, ' ', '')) as bigint))),
  named_struct('at', -1L, 'out', cast(array() as array<struct<lo: bigint, hi: bigint>>)),
  (a, x) -> named_struct('at', a.at + x.p + x.m, 'out', array_append(a.out, named_struct('lo', a.at + x.p, 'hi', a.at + x.p + x.m + 1L))),
  a -> a.out)"""


def words_joined(text: Column) -> Column:
    """The words of a lower-cased text with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, BETWEEN_WORDS, " ")), F.lit(" "))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of every row of docs.

    Texts with none of the rules' keywords are only counted. In the others each keyword that occurs calls up its rules; a detection is
    dropped if one of better priority, or of the same and longer or earlier in the rules, spans all its words. detections holds the label
    and words (first, end) of what is left, score the surest of them (spdx line 1, grant 0.9, bare name 0.6, none 0). Null and empty texts
    have no words, empty labels and null places; whole texts are read whatever their length; repeated rows count each; an empty table
    gives an empty result; other columns are not read."""
    by_key, keys = _rules_by_keyword()
    known = "array(" + ", ".join(f"'{k}'" for k in keys) + ")"
    base_rx = _literal("(?<= )(?:mit|apache|general public) license(?= )")
    low = docs.select("doc_id", lower_ascii(F.col("text")).alias("low"))
    # no rule matches a text without one of these; of several words only the first is asked for, since anything but words may part them
    hit = F.col("low").rlike(CC_BY)
    for hint in HINTS:
        hit = hit | F.contains(F.col("low"), F.lit(hint))
    marked = low.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(hit, words_joined(F.col("low"))).alias("t"))
    spans = marked.select(
        "doc_id", "n_words", "t",
        F.expr(f"case when t like '% license %' then {_SPANS.format(t='t', rx=base_rx)} end").alias("base"),
        F.array_compact(F.array(*[F.when(F.contains("t", F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items()])).alias("base_found"),
        F.expr(f"flatten(transform(filter({known}, k -> contains(t, k)), k -> element_at({by_key}, k)))").alias("rules"),
    )
    found = spans.withColumn(
        "found",
        F.expr(f"array_sort(flatten(transform(filter(rules, r -> t rlike r.rx), r -> transform({_SPANS.format(t='t', rx='r.rx')}, s -> named_struct('lo', s.lo, 'hi', -s.hi, 'prio', r.prio, 'nr', r.nr, 'label', r.label, 'sure', r.sure)))))"),
    ).drop("rules")
    # in order of start, longest first: what reaches furthest so far, by priority, decides containment
    kept = found.withColumn("kept", F.expr("""aggregate(found,
      named_struct('p1', -1L, 'p2', -1L, 'p3', -1L, 'out', cast(array() as array<struct<label: string, lo: bigint, hi: bigint, sure: double>>)),
      (a, d) -> named_struct(
        'p1', if(d.prio = 1, greatest(a.p1, -d.hi), a.p1), 'p2', if(d.prio = 2, greatest(a.p2, -d.hi), a.p2), 'p3', if(d.prio = 3, greatest(a.p3, -d.hi), a.p3),
        'out', if(greatest(a.p1, if(d.prio >= 2, a.p2, -1L), if(d.prio >= 3, a.p3, -1L)) >= -d.hi, a.out,
                  array_append(a.out, named_struct('label', d.label, 'lo', d.lo, 'hi', -d.hi, 'sure', d.sure)))),
      a -> a.out)"""))
    base_labels = F.coalesce("base_found", F.array().cast("array<string>"))
    return kept.select(
        "doc_id", "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.expr("try_element_at(base, 1).lo").alias("first_word"),
        F.expr("try_element_at(base, -1).lo").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.coalesce(F.expr("transform(kept, d -> d.label)"), F.array().cast("array<string>"))))), ",").alias("labels"),
        F.coalesce(F.expr("array_max(transform(kept, d -> d.sure))"), F.lit(0.0)).alias("score"),
        F.expr("transform(kept, d -> named_struct('label', d.label, 'first', d.lo, 'end', d.hi))").alias("detections"),
    )


def op1_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")
