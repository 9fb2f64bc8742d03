"""License scans: ordered signature rules behind a keyword prefilter. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ANY_CASE_WORD, LOWER, UPPER, pinned, whole

# The contract's phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label; keywords of which one must occur; name and SPDX identifier as regexes over lower-case words.
FAMILIES = [
    ("gpl", "gnu", r"gnu general public licen[cs]e", r"gpl [123] 0(?: only| or later)?"),
    ("lgpl", "lesser|library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", r"lgpl [23] [01](?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", r"agpl [13] 0(?: only| or later)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl 1 [123](?: only| or later)?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", r"apache [12] [01]"),
    ("mit", "mit", r"mit licen[cs]e", r"mit(?: 0)?"),
    ("bsd-2", "bsd|freebsd", r"(?:bsd 2 clause|simplified bsd|freebsd)(?: licen[cs]e)?", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|original bsd)(?: licen[cs]e)?", r"bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e", r"0bsd"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl [12] [01]"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl [12] 0"),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", r"edl 1 0"),
    ("cddl", "development", r"common development and distribution licen[cs]e", r"cddl 1 [01]"),
    ("cpl", "common", r"common public licen[cs]e", r"cpl 1 0"),
    ("ipl", "ibm", r"ibm public licen[cs]e", r"ipl 1 0"),
    ("eupl", "european", r"european union public licen[cs]e", r"eupl 1 [012]"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", r"libpng(?: 2 0)?"),
    ("boost", "boost", r"boost software licen[cs]e", r"bsl 1 0"),
    ("busl", "business", r"business source licen[cs]e", r"busl 1 1"),
    ("sspl", "server", r"server side public licen[cs]e", r"sspl 1 0"),
    ("elastic", "elastic", r"elastic licen[cs]e", r"elastic 2 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic [12] 0"),
    ("perl", "perl", r"same terms as perl(?: itself)?", r"artistic 1 0 perl"),
    ("python", "python", r"python software foundation licen[cs]e", r"(?:psf|python) 2 0"),
    ("php", "php", r"php licen[cs]e", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("openldap", "openldap", r"openldap public licen[cs]e", r"oldap 2 \d"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", r"ofl 1 [01]"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("afl", "academic", r"academic free licen[cs]e", r"afl 3 0"),
    ("osl", "open", r"open software licen[cs]e", r"osl 3 0"),
    ("upl", "universal", r"universal permissive licen[cs]e", r"upl 1 0"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e", r"odbl 1 0"),
    ("odc-by", "commons", r"open data commons attribution licen[cs]e", r"odc by 1 0"),
    ("pddl", "dedication", r"public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("public-domain", "domain", r"public domain", r"licenseref public domain"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?", r"cc0 1 0"),
    ("cc-by", "cc|creative", r"(?:cc by|creative commons attribution)(?! (?:nc|nd|sa|noncommercial|noderivatives|noderivs|sharealike|non|no|share))", r"cc by \d 0"),
    ("cc-by-sa", "cc|creative", r"(?:cc by sa|creative commons attribution share ?alike)", r"cc by sa \d 0"),
    ("cc-by-nd", "cc|creative", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))", r"cc by nd \d 0"),
    ("cc-by-nc", "cc|creative", r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:sa|nd|share|no))", r"cc by nc \d 0"),
    ("cc-by-nc-sa", "cc|creative", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", r"cc by nc sa \d 0"),
    ("cc-by-nc-nd", "cc|creative", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))", r"cc by nc nd \d 0"),
]

# Priority (lower is stronger), weight, and the forms in which a name N or an identifier S is stated.
FORMS = [
    (0, 1.0, r"spdx licen[cs]e identifier S"),
    (1, 0.95, r"(?:licen[cs]ed|released|distributed|available|published|provided|dedicated) (?:under|to|into) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N(?: licen[cs]e)?(?: (?:version|v))?(?: v?\d+)?(?: \d+)?"),
    (2, 0.85, r"N(?: licen[cs]e)? (?:(?:version|v) )?v?\d+(?: \d+)?"),
    (3, 0.8, r"(?:under|see|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N"),
    (4, 0.6, r"N"),
]

#: A text without any of these, lower-cased, can match no rule. Every rule above and every phrase of BASE needs one.
GATE = ["licen", "spdx", "cc", "creative", "public", "domain", "bsd", "perl", "wtfpl"]


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(label, keywords, regex, priority, weight, whether of the base), strongest first."""
    worded = lambda rx: rf"(?<= )(?:{rx})(?= )"
    made = [(label, phrase.split()[0], worded(phrase), 9, 0.5, True) for phrase, label in BASE.items()]
    for priority, weight, form in FORMS:
        for label, keyword, name, spdx in FAMILIES:
            keyword = "spdx" if "S" in form else keyword
            made.append((label, keyword, worded(form.replace("N", f"(?:{name})").replace("S", spdx)), priority, weight, False))
    return sorted(made, key=lambda r: r[3])


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base and detections: array<struct<first, past, label, priority, weight, base>>.

    first and past count words from 0. A detection is suppressed if it lies in the interval of one of the same or a
    stronger priority; base phrases count in n_base and stay among the detections in any case. Rules run only where
    one of their keywords begins a word of the text, and only on texts that pass GATE. Null and empty texts have no words and
    no detections; every row is judged by itself. Columns of docs named as the results are replaced.
    """
    kind = "array<struct<first:bigint,past:bigint,label:string,priority:int,weight:double,base:boolean>>"
    table = ", ".join(f"struct({_literal(la)} as label, array({', '.join(_literal(' ' + x) for x in k.split('|'))}) as kws, {_literal(rx)} as rx, {p} as priority, {w}D as weight, {str(b).lower()} as base)" for la, k, rx, p, w, b in rules())
    blanks = "length({0}) - length(replace({0}, ' ', ''))"
    found = rf"""flatten(transform(filter(array({table}), r -> arrays_overlap(r.kws, __kws)), r -> aggregate(
        split(regexp_replace(__norm, r.rx, '\u0001$0\u0002'), '[\u0001\u0002]'),
        named_struct('at', 0L, 'odd', false, 'out', cast(array() as {kind})),
        (s, p) -> named_struct('at', s.at + {blanks.format("p")}, 'odd', not s.odd, 'out', if(s.odd, array_append(s.out,
            named_struct('first', s.at - 1, 'past', s.at + {blanks.format("p")}, 'label', r.label, 'priority', r.priority, 'weight', r.weight, 'base', r.base)), s.out)),
        s -> s.out)))"""
    # Longer intervals first at each start, so that whatever holds an interval stands before it.
    order = "x -> named_struct('first', x.first, 'less', -x.past, 'priority', x.priority, 'd', x)"
    kept = f"""aggregate(array_sort(transform(__found, {order})),
        named_struct('open', cast(array() as {kind}), 'out', cast(array() as {kind})),
        (s, y) -> named_struct('open', array_append(filter(s.open, a -> a.past > y.first), y.d),
            'out', if(y.d.base or not exists(s.open, a -> not a.base and a.past >= y.d.past and a.priority <= y.priority), array_append(s.out, y.d), s.out)),
        s -> s.out)"""
    passes = F.lit(False)
    for k in GATE:
        passes |= F.col("__lower").contains(k)
    had = [c for c in docs.columns if c not in ("n_words", "n_base", "detections")]
    # The caller's columns travel in one struct, so that none can clash with those made here.
    df = docs.select(F.struct(*had).alias("__row"), F.col(text_col).alias("__text"))
    # Lower-cased once: inside a condition it would be done again for each keyword.
    df = df.withColumn("__lower", pinned(F.lower(whole("__text"))))
    df = df.withColumn("n_words", F.regexp_count(whole("__text"), F.lit(ANY_CASE_WORD)).cast("long"))
    words = F.regexp_extract_all(F.translate(whole("__text"), UPPER, LOWER), F.lit(ANY_CASE_WORD), F.lit(0))
    df = df.withColumn("__norm", F.when(passes, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit("")))
    # Each keyword is sought once, however many rules have it.
    keywords = ", ".join(_literal(" " + x) for x in sorted({x for _, k, *_ in rules() for x in k.split("|")}))
    df = df.withColumn("__kws", pinned(F.expr(f"filter(array({keywords}), k -> contains(__norm, k))")))
    df = df.withColumn("__found", pinned(F.when(F.size("__kws") > 0, F.expr(found)).otherwise(F.expr(f"cast(array() as {kind})"))))
    df = df.withColumn("detections", pinned(F.when(F.size("__found") > 0, F.expr(kept)).otherwise(F.expr(f"cast(array() as {kind})"))))
    return df.select(*[F.col("__row").getField(c).alias(c) for c in had], "n_words", "detections", F.size(F.filter("__found", lambda x: x["base"])).cast("long").alias("n_base"))
