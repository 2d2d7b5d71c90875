"""Operator 2 [native]: licence scans by sentence rules.

Two steps, as sentence-based licence recognisers work. (1) Texts that hold a word of a known sentence are cut into
sentences, and each is normalised (lower case, letters and digits only, single blanks) and mapped to an identifier: that
of the whole known sentence (KNOWN) that it is; or of the first one from which it differs in few words, none of which
denies; or of the first key phrase (SENTENCES) that it holds, for sentences that only name a licence. (2) The identifiers,
in text order, are matched against ordered licence rules: a rule is a sequence of identifiers; the first rule that
matches takes its identifiers out of the sequence, so a later, more general rule sees only what is left. What no rule
takes is reported as unmatched sentences.

Only DataFrame functions, row by row: no shuffle, no Python on the executors. The rules are constants, so the plan's
size is fixed. `license_sql` writes the same operator in DuckDB's SQL from the same tables and cuts.

Defined results: null or empty text, or one without such words, has no sentences and no licences; a licence is named
once per document, in rule order; all rights reserved beside a grant takes nothing back, and alone is proprietary;
rows without doc_id and repeated rows give a row each; empty tables no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

try:
    from re import _parser as sre
except ImportError:
    import sre_parse as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole known licence sentences, normalised: fixed values, the wording of public licences and their notices.
KNOWN: tuple[tuple[str, str], ...] = (
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is_software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit_liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd_grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("as_is_holders", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache2_grant", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("apache2_as_is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", "see the gnu general public license for more details"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program"),
    ("mpl2_terms", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2_copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib_altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("bsl1_terms", "distributed under the boost software license version 1 0"),
    ("bsl1_grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("epl2_terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: A sentence may have this share of a known one's words more or less, and none of these: denials, families, versions.
NEAR_SHARE = 0.15
TELLING = ("not", "no", "never", "nor", "cannot", "isn", "aren", "without", "except", "unless", "affero", "lesser", "library", *map(str, range(10)))

#: Known licence sentences: identifier, key phrase in a normalised sentence (a regular expression). The first wins.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("denied", r"\b(?:not|never|no longer|nor|(?:is|are|was|were|has|have|be)n t) (?:been |be )?(?:licensed|relicensed|released|distributed|available|published|covered) under\b"),
    ("spdx_apache2", r"\bspdx license identifier apache 2 0"),
    ("spdx_mit", r"\bspdx license identifier mit\b"),
    ("spdx_bsd3", r"\bspdx license identifier bsd 3 clause"),
    ("spdx_bsd2", r"\bspdx license identifier bsd 2 clause"),
    ("spdx_isc", r"\bspdx license identifier isc\b"),
    ("spdx_gpl3_later", r"\bspdx license identifier gpl 3 0 or later"),
    ("spdx_gpl2_later", r"\bspdx license identifier gpl 2 0 or later"),
    ("spdx_gpl3", r"\bspdx license identifier gpl 3 0"),
    ("spdx_gpl2", r"\bspdx license identifier gpl 2 0"),
    ("spdx_agpl3_later", r"\bspdx license identifier agpl 3 0 or later"),
    ("spdx_agpl3", r"\bspdx license identifier agpl 3 0"),
    ("spdx_agpl", r"\bspdx license identifier agpl\b"),
    ("spdx_lgpl3_later", r"\bspdx license identifier lgpl 3 0 or later"),
    ("spdx_lgpl3", r"\bspdx license identifier lgpl 3 0"),
    ("spdx_lgpl21_later", r"\bspdx license identifier lgpl 2 1 or later"),
    ("spdx_lgpl21", r"\bspdx license identifier lgpl 2 1"),
    ("spdx_lgpl", r"\bspdx license identifier lgpl\b"),
    ("spdx_epl2", r"\bspdx license identifier epl 2 0"),
    ("spdx_epl1", r"\bspdx license identifier epl 1 0"),
    ("spdx_bsl1", r"\bspdx license identifier bsl 1 0"),
    ("spdx_zlib", r"\bspdx license identifier zlib\b"),
    ("spdx_unlicense", r"\bspdx license identifier unlicense\b"),
    ("spdx_mpl2", r"\bspdx license identifier mpl 2 0"),
    ("cc_by_nc_sa4", r"\b(?:cc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0)"),
    ("cc_by_nc_nd4", r"\b(?:cc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0)"),
    ("cc_by_nc4", r"\b(?:cc by nc 4 0|creative commons attribution non ?commercial 4 0)"),
    ("cc_by_sa4", r"\b(?:cc by sa 4 0|creative commons attribution share ?alike 4 0)"),
    ("cc_by_nd4", r"\b(?:cc by nd 4 0|creative commons attribution no ?deriv(?:ative)?s 4 0)"),
    ("cc_by4", r"\b(?:cc by 4 0|creative commons attribution 4 0)"),
    ("cc0", r"\b(?:cc0|creative commons zero)\b"),
    ("apache2_or_mit", r"\bapache license (?:version )?2 0 (?:license )?or (?:the )?mit license|\bmit license or (?:the )?apache license (?:version )?2 0"),
    ("apache2_grant", r"\b(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache (?:software )?license (?:version |v)?2 0"),
    ("apache2_comply", r"\byou may not use this (?:file|work|software) except in compliance with the license"),
    ("apache2_copy", r"\byou may obtain a copy of the license at\b"),
    ("apache2_as_is", r"\bdistributed under the license is distributed on an as is basis"),
    ("apache2_see", r"\bsee the license for the specific language governing permissions"),
    ("apache2_title", r"^(?:the )?apache license(?: version 2 0(?: january 2004)?(?: http www apache org licenses)?)?$"),
    ("mit_title", r"^(?:the )?mit license(?: mit)?$"),
    ("mit_ref", r"\b(?:(?:released|licensed|distributed|available) under (?:the )?|under the )(?:terms of the )?mit license|\bmit licensed\b"),
    ("mit_grant", r"\bpermission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"\babove copyright notice and this permission notice shall be included in all copies"),
    ("isc_grant", r"\bpermission to use copy modify and or distribute this software for any purpose"),
    ("as_is_software", r"\bsoftware is provided as is without warranty of any kind"),
    ("as_is_author", r"\bsoftware is provided as is and the author disclaims all warranties"),
    ("as_is_holders", r"\bprovided by the copyright holders and contributors as is"),
    ("mit_liability", r"\bin no event shall the authors or copyright holders be liable"),
    ("bsd_liability", r"\bin no event shall the copyright (?:holders?|owner) or contributors be liable"),
    ("bsd_ref", r"\b(?:released|licensed|distributed) under (?:the |a )?(?:3 clause |2 clause |modified |new )?bsd (?:style )?license"),
    ("bsd_grant", r"\bredistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"\bredistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"\bredistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"\bneither the name of .* may be used to endorse or promote products"),
    ("agpl3_later", r"\bgnu affero general public license .*(?:v|version )3(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later"),
    ("agpl3_ref", r"\bgnu affero general public license\b"),
    ("lgpl3_later", r"\bgnu (?:lesser|library) general public license .*(?:v|version )3(?: 0)?(?: of the license)? or (?:at your option )?(?:any )?later"),
    ("lgpl21_later", r"\bgnu (?:lesser|library) general public license .*(?:v|version )2 1(?: of the license)? or (?:at your option )?(?:any )?later"),
    ("lgpl3_ref", r"\bgnu (?:lesser|library) general public license (?:v|version )3\b"),
    ("lgpl21_ref", r"\bgnu (?:lesser|library) general public license (?:v|version )2 1\b"),
    ("lgpl_ref", r"\bgnu (?:lesser|library) general public license"),
    ("gpl3_later", r"\bgnu general public license (?:v|version )3(?: 0)? or (?:at your option )?(?:any )?later"),
    ("gpl2_later", r"\bgnu general public license (?:v|version )2(?: 0)? or (?:at your option )?(?:any )?later"),
    ("gpl3_ref", r"\blicensed under (?:the )?(?:terms of the )?gnu general public license (?:v|version )3|\bgnu general public license (?:v|version )3\b"),
    ("gpl2_ref", r"\blicensed under (?:the )?(?:terms of the )?gnu general public license (?:v|version )2|\bgnu general public license (?:v|version )2\b"),
    ("gpl3_terms", r"\bredistribute it and or modify it under the terms of the gnu general public license .*version 3"),
    ("gpl2_terms", r"\bredistribute it and or modify it under the terms of the gnu general public license .*version 2"),
    ("gpl_hope", r"\bdistributed in the hope that it will be useful but without any warranty"),
    ("gpl_details", r"\bsee the gnu general public license for more details"),
    ("gpl_copy", r"\byou should have received a copy of the gnu general public license"),
    ("gpl_ref", r"\bgnu general public license\b"),
    ("mpl2_terms", r"\bsubject to the terms of the mozilla public license v(?:ersion)? ?2 0"),
    ("mpl2_copy", r"\bif a copy of the mpl was not distributed with this file you can obtain one"),
    ("epl2_terms", r"\beclipse public license (?:v ?|version )?2 0"),
    ("epl1_terms", r"\beclipse public license (?:v ?|version )?1 0"),
    ("bsl1_terms", r"\bboost software license (?:v ?|version )?1 0"),
    ("zlib_ref", r"\bunder (?:the )?(?:terms of the )?zlib license"),
    ("zlib_grant", r"\bpermission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib_altered", r"\baltered source versions must be plainly marked as such"),
    ("unlicense", r"\bfree and unencumbered software released into the public domain"),
    ("public_domain", r"\b(?:is|are|placed|released) (?:in|into) the public domain"),
    ("all_rights", r"\ball rights reserved\b"),
    ("copyright_line", r"\bcopyright (?:c )?(?:[0-9]{4}|by)\b"),
)

#: Ordered rules: licence, sequence of identifiers (in brackets) as a regular expression over the identifier string.
RULES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0 OR MIT", r"\[apache2_or_mit\]"),
    ("Apache-2.0", r"\[apache2_grant\](?:\[apache2_comply\]\[apache2_copy\](?:\[apache2_as_is\])?(?:\[apache2_see\])?)?|\[spdx_apache2\]|\[apache2_title\]"),
    ("MIT", r"\[mit_grant\]\[mit_notice\](?:\[as_is_software\])?(?:\[mit_liability\])?|\[mit_ref\]|\[spdx_mit\]|\[mit_title\]"),
    ("ISC", r"\[isc_grant\](?:\[as_is_author\])?|\[spdx_isc\]"),
    ("BSD-3-Clause", r"\[bsd_grant\]\[bsd_source\]\[bsd_binary\]\[bsd_endorse\](?:\[as_is_holders\])?(?:\[bsd_liability\])?|\[spdx_bsd3\]"),
    ("BSD-2-Clause", r"\[bsd_grant\]\[bsd_source\]\[bsd_binary\](?:\[as_is_holders\])?(?:\[bsd_liability\])?|\[spdx_bsd2\]"),
    ("BSD", r"\[bsd_ref\]"),
    ("AGPL-3.0-or-later", r"\[agpl3_later\](?:\[gpl_hope\])?(?:\[agpl3_ref\])*|\[spdx_agpl3_later\]"),
    ("AGPL-3.0-only", r"\[spdx_agpl3\]"),
    ("AGPL", r"(?:\[agpl3_ref\])+|\[spdx_agpl\]"),
    ("LGPL-3.0-or-later", r"\[lgpl3_later\](?:\[gpl_hope\])?(?:\[lgpl_ref\])*|\[spdx_lgpl3_later\]"),
    ("LGPL-2.1-or-later", r"\[lgpl21_later\](?:\[gpl_hope\])?(?:\[lgpl_ref\])*|\[spdx_lgpl21_later\]"),
    ("LGPL-3.0-only", r"\[lgpl3_ref\]|\[spdx_lgpl3\]"),
    ("LGPL-2.1-only", r"\[lgpl21_ref\]|\[spdx_lgpl21\]"),
    ("LGPL", r"(?:\[lgpl_ref\])+|\[spdx_lgpl\]"),
    ("GPL-3.0-or-later", r"\[gpl3_terms\](?:\[gpl_hope\])?(?:\[gpl_details\])?(?:\[gpl_copy\])?|\[gpl3_later\]|\[spdx_gpl3_later\]"),
    ("GPL-2.0-or-later", r"\[gpl2_terms\](?:\[gpl_hope\])?(?:\[gpl_details\])?(?:\[gpl_copy\])?|\[gpl2_later\]|\[spdx_gpl2_later\]"),
    ("GPL-3.0-only", r"\[gpl3_ref\]|\[spdx_gpl3\]"),
    ("GPL-2.0-only", r"\[gpl2_ref\]|\[spdx_gpl2\]"),
    ("GPL", r"\[gpl_ref\]|\[gpl_copy\]"),
    ("MPL-2.0", r"\[mpl2_terms\](?:\[mpl2_copy\])?|\[spdx_mpl2\]"),
    ("CC-BY-NC-SA-4.0", r"\[cc_by_nc_sa4\]"),
    ("CC-BY-NC-ND-4.0", r"\[cc_by_nc_nd4\]"),
    ("CC-BY-NC-4.0", r"\[cc_by_nc4\]"),
    ("CC-BY-SA-4.0", r"\[cc_by_sa4\]"),
    ("CC-BY-ND-4.0", r"\[cc_by_nd4\]"),
    ("CC-BY-4.0", r"\[cc_by4\]"),
    ("CC0-1.0", r"\[cc0\]"),
    ("EPL-2.0", r"\[epl2_terms\]|\[spdx_epl2\]"),
    ("EPL-1.0", r"\[epl1_terms\]|\[spdx_epl1\]"),
    ("BSL-1.0", r"\[bsl1_terms\](?:\[bsl1_grant\])?|\[bsl1_grant\]|\[spdx_bsl1\]"),
    ("Zlib", r"(?:\[zlib_as_is\])?\[zlib_grant\](?:\[zlib_altered\])?|\[zlib_ref\]|\[spdx_zlib\]"),
    ("Unlicense", r"\[unlicense\]|\[spdx_unlicense\]"),
    ("Public-Domain", r"\[public_domain\]"),
    # only where no other rule has taken anything: a taken sequence leaves a bar
    ("Proprietary", r"^[^|]*\[all_rights\][^|]*$"),
)

# A sentence starts at a line that begins like one ("Redistributions of ..."), or after a sentence end; other line
# ends are wrapping. Comment marks at line starts go. What would cut a known sentence is taken out of the way before: a
# line that begins with a word from inside one is wrapping, "v. 2.0" is no end, and the GPL's terms go on after
# "Foundation;". \u0001 starts a sentence. No pattern looks around, so that both engines have it.
_INNER = r"(?:Licen[cs]e|Version|Public|General|Affero|Lesser|Library|Apache|Mozilla|Eclipse|Boost|Foundation|Free Software|Software|You can|Creative Commons|Commons|Attribution|Zero|Identifier|Clause|Modified|New|Style|Domain|Authors?|Holders?|Contributors?|Owner)\b|Share|Non|No ?Deriv|Copyright (?:[Hh]olders?|[Oo]wner)\b"
_MARKS = r"[ \t]*(?:#+|//+|\*+|--+|;+)?[ \t]*"
_CUTS = (
    (r"\r", ""),
    (r"\b([vV])\.", "$1 "),
    (r";([\s#/*;-]*(?:either )?version)", " $1"),
    (r"\n[ \t]*\n", "\n\u0001"),
    (rf"\n{_MARKS}({_INNER})", " $1"),
    (rf"\n{_MARKS}([A-Z][a-z])", "\n\u0001$1"),
    (r"([.!?;])[\"')]*\s+", "$1\u0001"),
)
_NORMAL = (r"[^a-z0-9]+", " ")
#: A sentence with an SPDX expression is one sentence for each licence of the expression.
_SPDX, _EITHER = "spdx-license-identifier:", r"[ \t]+\(?(?:or|and|with)[ \t]+\(?"


def sentences(text: Column) -> Column:
    """The text's normalised sentences."""
    for pattern, to in _CUTS:
        text = F.regexp_replace(text, pattern, to)
    raw = F.split(F.lower(text), "\u0001")
    expression = lambda s: F.transform(F.split(s, _EITHER), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(_SPDX), p)))
    each = F.flatten(F.transform(raw, lambda s: F.when(s.contains(_SPDX), expression(s)).otherwise(F.array(s))))
    return F.transform(each, lambda s: F.trim(F.regexp_replace(s, *_NORMAL)))


def _bound(sentence: str) -> int:
    """How many words a sentence may have more and less than a known one."""
    return int(len(set(sentence.split())) * NEAR_SHARE)


def identifier(sentence: Column) -> Column:
    """The licence sentence's identifier, or null."""
    words_of = F.split(sentence, " ")
    exact = F.create_map(*(F.lit(x) for name, known in KNOWN for x in (known, name)))[sentence]
    near = F.lit(None).cast("string")
    for name, known in reversed(KNOWN):
        own = F.array(*map(F.lit, dict.fromkeys(known.split())))
        apart = F.concat(F.array_except(own, words_of), F.array_except(words_of, own))
        near = F.when(F.size(words_of).between(len(known.split()) - _bound(known), len(known.split()) + _bound(known)) & (F.size(apart) <= _bound(known)) & ~F.arrays_overlap(apart, F.array(*map(F.lit, TELLING))), name).otherwise(near)
    held = F.when(sentence.rlike(SENTENCES[0][1]), SENTENCES[0][0])
    for name, phrase in SENTENCES[1:]:
        held = held.when(sentence.rlike(phrase), name)
    return F.coalesce(exact, F.when(F.size(words_of) >= 8, near), held)


def spellings(phrase: str) -> set[str]:
    """What a key phrase matches, each alternative spelled out; a line end stands for what isn't literal."""

    def each(items) -> set[str]:
        return {"".join(x) for x in product(*(one(*i) for i in items))}

    def one(op, arg) -> set[str]:
        if op is sre.LITERAL:
            return {chr(arg)}
        if op is sre.AT:
            return {""}
        if op is sre.SUBPATTERN:
            return each(arg[-1])
        if op is sre.BRANCH:
            return set().union(*map(each, arg[1]))
        if op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            return {""} | each(arg[2])
        return {"\n"}

    return each(sre.parse(phrase))


def words() -> str:
    """A regular expression that any lower-case text or sentence with a key phrase matches: the longest word of each spelling."""
    longest = {max(s.split(), key=len) for _, phrase in SENTENCES for s in spellings(phrase)}
    # a sentence that differs from a known one in few words holds one more than that many of its longest words
    for _, known in KNOWN:
        longest |= set(sorted(set(known.split()), key=lambda w: (-len(w), w))[: _bound(known) + 1])
    return "|".join(sorted(rf"\b{w}\b" if len(w) < 4 else w for w in longest if not any(o != w and len(o) > 3 and o in w for o in longest)))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (recognised), sentence_ids, licenses, unmatched: the last three joined by commas."""
    text, known = F.col(text_col), words()
    worth = F.transform(F.filter(sentences(text), lambda s: s.rlike(known)), identifier)
    found = F.when(F.lower(F.translate(text, "\r", "")).rlike(known), F.filter(worth, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    out = out.select("doc_id", "ids", F.concat(F.lit(""), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("["), x, F.lit("]"))), "")).alias("rest"))
    # one column a rule: whether it matches what the rules before it left; then what it leaves
    named = []
    for k, (_, rule) in enumerate(RULES):
        out = out.select(*out.columns, F.col("rest").rlike(rule).alias(f"hit{k}")).withColumn("rest", F.when(F.col(f"hit{k}"), F.regexp_replace("rest", rule, "|")).otherwise(F.col("rest")))
        named.append(F.when(F.col(f"hit{k}"), F.lit(RULES[k][0])))
    left = F.trim(F.regexp_replace(F.regexp_replace("rest", r"\|", ""), r"[\[\]]+", " "))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.concat_ws(",", *named).alias("licenses"), F.regexp_replace(left, " ", ",").alias("unmatched"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql(source: str = "documents") -> str:
    """DuckDB SQL for license_scan's rows."""
    text = "text"
    for pattern, to in _CUTS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, replace({_quoted(to.replace('$1', chr(92) + '1').replace(chr(1), '@'))}, '@', chr(1)), 'g')"
    case = "CASE " + " ".join(f"WHEN regexp_matches(s, {_quoted(p)}) THEN {_quoted(n)}" for n, p in SENTENCES) + " END"
    known = ", ".join(f"({k}, {_quoted(n)}, {_quoted(t)}, {_bound(t)})" for k, (n, t) in enumerate(KNOWN))
    telling = "[" + ", ".join(map(_quoted, TELLING)) + "]"
    of = "len(list_filter(list_distinct({0}), lambda x: NOT list_contains({1}, x)))"
    one, many = of.format("k.w", "p.w"), of.format("p.w", "k.w")
    worth = words()
    steps = [f"""known AS (SELECT *, string_split(t, ' ') AS w FROM (VALUES {known}) v(k, name, t, bound))""",
             f"""doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM {source})""",
             f"""cut AS (SELECT r, unnest(string_split(lower({text}), chr(1))) AS raw, generate_subscripts(string_split(lower({text}), chr(1)), 1) AS a FROM doc WHERE regexp_matches(lower(replace(text, chr(13), '')), {_quoted(worth)}))""",
             f"""part AS (SELECT r, a, generate_subscripts(ps, 1) AS b, unnest(ps) AS piece FROM (SELECT r, a, CASE WHEN contains(raw, '{_SPDX}') THEN string_split_regex(raw, {_quoted(_EITHER)}) ELSE [raw] END AS ps FROM cut) x)""",
             f"""piece AS MATERIALIZED (SELECT r, a, b, s, string_split(s, ' ') AS w FROM (SELECT r, a, b, trim(regexp_replace(lower(CASE WHEN b > 1 THEN '{_SPDX}' || piece ELSE piece END), '{_NORMAL[0]}', ' ', 'g')) AS s FROM part) x WHERE regexp_matches(s, {_quoted(worth)}))""",
             f"""near AS (SELECT r, a, b, min_by(name, k.k) AS name FROM piece p JOIN known k ON len(p.w) >= 8 AND len(p.w) BETWEEN len(k.w) - bound AND len(k.w) + bound AND {one} + {many} <= bound
 AND NOT list_has_any(list_filter(k.w || p.w, lambda x: list_contains(k.w, x) <> list_contains(p.w, x)), {telling}) GROUP BY r, a, b)""",
             f"""named AS (SELECT p.r, a, b, coalesce(k.name, n.name, {case}) AS name FROM piece p LEFT JOIN known k ON k.t = s LEFT JOIN near n USING (r, a, b))""",
             """t0 AS (SELECT doc.r, doc_id, coalesce(ids, []) AS ids, coalesce(array_to_string(list_transform(ids, lambda x: '[' || x || ']'), ''), '') AS rest, []::VARCHAR[] AS got FROM doc LEFT JOIN (SELECT r, list(name ORDER BY a, b) AS ids FROM named WHERE name IS NOT NULL GROUP BY r) i USING (r))"""]  # fmt: skip
    for k, (name, rule) in enumerate(RULES):
        steps.append(f"t{k + 1} AS (SELECT doc_id, ids, regexp_replace(rest, {_quoted(rule)}, '|', 'g') AS rest, CASE WHEN regexp_matches(rest, {_quoted(rule)}) THEN list_append(got, {_quoted(name)}) ELSE got END AS got FROM t{k})")
    left = r"replace(trim(regexp_replace(replace(rest, '|', ''), '[\[\]]+', ' ', 'g')), ' ', ',')"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, array_to_string(got, ',') AS licenses, {left} AS unmatched FROM t{len(RULES)}"
