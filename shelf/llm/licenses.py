"""License scans: ordered signature rules over a text's words, gated by keywords, overlaps resolved.

A text is read as its words in lower case, joined by single blanks, so that line ends, comment marks and punctuation never
stand in a rule's way. Rules are regular expressions over that form, in an order of kinds: base phrases, notices, tags,
grants, addresses, names, remarks. A rule is tried only on texts that have its keywords. A detection is suppressed if a
detection of an earlier kind, or a longer one (of equal ones: of an earlier rule) of its own kind, contains its interval
of words; base phrases are never suppressed. The order of "better and containing" is transitive, so it makes no
difference whether what suppresses is itself suppressed.

Cases: null text counts as empty and, like a text without detections, scores 0; rows repeated under one doc_id are scanned
each, null doc_id stays null; a detection may be as long as the text; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in order of priority, and how sure a detection of the kind is.
KINDS = {"base": 0.95, "notice": 0.95, "tag": 0.98, "grant": 0.9, "address": 0.85, "name": 0.7, "remark": 0.4}
_PRIORITY = {k: n for n, k in enumerate(KINDS)}

# The phrases that are always reported, at every place.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

_L = "licen[cs]e"
_LW = "license|licence"
_V = "(?:version |v)?"
#: label; what a grant calls it; its full name, which stands for itself; identifier in tags; address. Keywords: of the
#: grant and of the name, blanks for "and", bars for "or". Addresses and tags have keywords of their own below.
FAMILIES = [
    ("mit", "(?:mit|expat|x11)", f"(?:mit|expat|mit x11|x11) {_L}", "(?:mit|x11)", "opensource org licenses mit", "mit|expat|x11", f"mit|expat|x11 {_LW}"),
    ("mit-0", "mit no attribution", "mit no attribution", "mit 0", "opensource org licenses mit 0", "mit attribution", "mit attribution"),
    ("apache-1.1", f"apache(?: software)?(?: {_L})? {_V}1 1", f"apache(?: software)? {_L} {_V}1 1", "apache 1 1", "apache org licenses license 1 1", "apache", f"apache {_LW}"),
    ("apache-2", f"(?:asl|apache(?: software)?)(?: {_L})?(?: {_V}2(?: 0)?)?", f"apache(?: software)? {_L} {_V}2(?: 0)?", "apache 2 0", "apache org licenses license 2 0", "apache|asl", f"apache {_LW}"),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", f"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: {_L})?", "bsd 2 clause", "opensource org licenses bsd 2 clause", "bsd|freebsd", "bsd clause|simplified"),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)", f"(?:bsd 3 clause|3 clause bsd|three clause bsd|(?:new|revised|modified) bsd {_L})(?: {_L})?", "bsd 3 clause", "opensource org licenses bsd 3 clause", "bsd", "bsd"),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", f"(?:bsd 4 clause|4 clause bsd|four clause bsd|(?:original|old) bsd {_L})(?: {_L})?", "bsd 4 clause", "spdx org licenses bsd 4 clause", "bsd", "bsd"),
    ("bsd", "(?:a |the )?bsd(?: style)?", f"bsd(?: style)? {_L}", "0bsd", "opensource org licenses 0bsd", "bsd", f"bsd {_LW}"),
    ("gpl-1", f"(?:gnu )?(?:gpl|general public {_L}) {_V}1(?: 0)?", f"(?:gnu gpl|gpl|general public {_L}) {_V}1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses old licenses gpl 1 0", "gpl|general", "gpl|general"),
    ("gpl-2", f"(?:gnu )?(?:gpl|general public {_L}) {_V}2(?: 0)?", f"(?:gnu )?(?:gpl|general public {_L}) (?:version |v)2(?: 0)?(?: or (?:\\w+ )?later)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0", "gpl|general", "gpl|general"),
    ("gpl-3", f"(?:gnu )?(?:gpl|general public {_L}) {_V}3(?: 0)?", f"(?:gnu )?(?:gpl|general public {_L}) (?:version |v)3(?: 0)?(?: or (?:\\w+ )?later)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0", "gpl|general", "gpl|general"),
    ("gpl", f"(?:gnu )?(?:gpl|general public {_L})", f"(?:gnu general public {_L}|gnu gpl|gpl {_L}|gplv2|gplv3)", "gpl", "gnu org licenses gpl", "gpl|general", "gpl|general|gplv2|gplv3"),
    ("lgpl-2", f"(?:gnu )?(?:lgpl|library general public {_L}) {_V}2(?: 0)?", f"(?:gnu )?(?:lgpl|library general public {_L}) (?:version |v)2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses old licenses lgpl 2 0", "lgpl|library", "lgpl|library"),
    ("lgpl-2.1", f"(?:gnu )?(?:lgpl|lesser general public {_L}) {_V}2 1", f"(?:gnu )?(?:lgpl|lesser general public {_L}) (?:version |v)?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1", "lgpl|lesser", "lgpl|lesser"),
    ("lgpl-3", f"(?:gnu )?(?:lgpl|lesser general public {_L}) {_V}3(?: 0)?", f"(?:gnu )?(?:lgpl|lesser general public {_L}) (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0", "lgpl|lesser", "lgpl|lesser"),
    ("lgpl", f"(?:gnu )?(?:lgpl|lesser general public {_L})", f"(?:gnu lesser general public {_L}|gnu lgpl|lgpl {_L})", "lgpl", "gnu org licenses lgpl", "lgpl|lesser", "lgpl|lesser"),
    ("agpl-3", f"(?:gnu )?(?:agpl|affero general public {_L})(?: {_V}3(?: 0)?)?", f"(?:gnu )?(?:agplv3|affero general public {_L})(?: {_V}3(?: 0)?)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl(?: 3 0)?", "agpl|affero", "agplv3|affero"),
    ("gfdl", f"(?:gnu )?(?:gfdl|free documentation {_L})", f"gnu free documentation {_L}", "gfdl 1 [123](?: only| or later)?", "gnu org licenses fdl", "gfdl|documentation", "gnu documentation"),
    ("mpl-1.1", f"(?:mpl|mozilla public {_L}) {_V}1 1", f"mozilla public {_L} {_V}1 1", "mpl 1 1", "mozilla org mpl(?: mpl)? 1 1", "mpl|mozilla", "mozilla"),
    ("mpl-2", f"(?:mpl|mozilla public {_L})(?: {_V}2(?: 0)?)?", f"mozilla public {_L}(?: {_V}2(?: 0)?)?", "mpl 2 0", "mozilla org mpl 2 0", "mpl|mozilla", "mozilla"),
    ("epl-1", f"(?:epl|eclipse public {_L})(?: {_V}1(?: 0)?)?", f"eclipse public {_L} {_V}1(?: 0)?", "epl 1 0", "eclipse org legal epl v10", "epl|eclipse", "eclipse"),
    ("epl-2", f"(?:epl|eclipse public {_L}) {_V}2(?: 0)?", f"eclipse public {_L} {_V}2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:2 0|v20)", "epl|eclipse", "eclipse"),
    ("edl", f"eclipse distribution {_L}", f"eclipse distribution {_L}", "edl 1 0", "eclipse org org documents edl v10", "eclipse", "eclipse"),
    ("cddl-1", f"(?:cddl|common development and distribution {_L})", f"common development and distribution {_L}(?: {_V}1(?: [01])?)?", "cddl 1 [01]", "opensource org licenses cddl", "cddl|development", "development"),
    ("cpl-1", f"(?:cpl|common public {_L})", f"common public {_L}(?: {_V}1(?: 0)?)?", "cpl 1 0", "opensource org licenses cpl", "cpl|common", "common"),
    ("eupl-1.2", f"(?:eupl|european union public {_L})", f"(?:eupl {_V}1 2|european union public {_L})", "eupl 1 [012]", "joinup ec europa eu \\w+ eupl", "eupl|european", "eupl|european"),
    ("isc", "isc", f"isc {_L}", "isc", "opensource org licenses isc", "isc", f"isc {_LW}"),
    ("zlib", "zlib(?: libpng)?", f"zlib(?: libpng)? {_L}", "zlib", "opensource org licenses zlib", "zlib", f"zlib {_LW}"),
    ("libpng", "libpng", f"libpng {_L}", "libpng(?: 2 0)?", "libpng org pub png src libpng license", "libpng", f"libpng {_LW}"),
    ("bsl-1", f"boost(?: software)?(?: {_L})?", f"boost software {_L}(?: {_V}1 0)?", "bsl 1 0", "boost org license 1 0", "boost", "boost"),
    ("artistic-1", f"artistic(?: {_L})? {_V}1(?: 0)?", f"artistic {_L} {_V}1(?: 0)?", "artistic 1 0(?: perl| cl8)?", "opensource org licenses artistic license 1 0", "artistic", "artistic"),
    ("artistic-2", f"artistic(?: {_L})?(?: {_V}2(?: 0)?)?", f"artistic {_L}(?: {_V}2(?: 0)?)?", "artistic 2 0", "opensource org licenses artistic license 2 0", "artistic", "artistic"),
    ("perl", f"same terms as perl(?: itself)?|perl {_L}", f"(?:same terms as perl(?: itself)?|perl artistic {_L})", "perl", "dev perl org licenses", "perl", "perl"),
    ("python-2", f"(?:psf|python(?: software foundation)?) {_L}", f"(?:psf|python software foundation) {_L}", "(?:psf|python) 2 0", "docs python org \\d license", "psf|python", "psf|python"),
    ("php-3", f"php {_L}", f"php {_L}(?: {_V}3(?: 0[01])?)?", "php 3 0[01]?", "php net license 3 0", "php", f"php {_LW}"),
    ("ruby", f"ruby(?: s)? {_L}", f"ruby s {_L}", "ruby", "ruby lang org en about license", "ruby", f"ruby {_LW}"),
    ("openssl", f"openssl {_L}", f"openssl {_L}", "openssl", "openssl org source license", "openssl", "openssl"),
    ("postgresql", f"postgresql {_L}", f"postgresql {_L}", "postgresql", "opensource org licenses postgresql", "postgresql", f"postgresql {_LW}"),
    ("curl", f"curl {_L}", f"curl {_L}", "curl", "curl (?:haxx se|se) docs copyright", "curl", f"curl {_LW}"),
    ("icu", f"icu {_L}", f"icu {_L}", "icu", "unicode org copyright html", "icu", f"icu {_LW}"),
    ("unicode", f"unicode {_L}", f"unicode {_L} agreement", "unicode (?:dfs 201[56]|tou|3 0)", "unicode org license", "unicode", f"unicode {_LW}"),
    ("ms-pl", f"(?:ms pl|microsoft public {_L})", f"microsoft public {_L}", "ms pl", "opensource org licenses ms pl", "microsoft|ms", "microsoft"),
    ("ms-rl", f"(?:ms rl|microsoft reciprocal {_L})", f"microsoft reciprocal {_L}", "ms rl", "opensource org licenses ms rl", "microsoft|ms", "microsoft"),
    ("upl-1", f"(?:upl|universal permissive {_L})", f"universal permissive {_L}", "upl 1 0", "oss oracle com licenses upl", "upl|universal", "universal"),
    ("ofl-1.1", f"(?:sil )?(?:ofl|open font {_L})", f"(?:sil )?open font {_L}(?: {_V}1 [01])?", "ofl 1 [01](?: (?:no )?rfn)?", "scripts sil org ofl", "ofl|font", "font"),
    ("afl-3", f"(?:afl|academic free {_L})", f"academic free {_L}(?: {_V}3(?: 0)?)?", "afl [123] [012]", "opensource org licenses afl 3 0", "afl|academic", "academic"),
    ("osl-3", f"(?:osl|open software {_L})", f"open software {_L}(?: {_V}3(?: 0)?)?", "osl [123] [01]", "opensource org licenses osl 3 0", "osl|software", "open software"),
    ("ncsa", "ncsa(?: open source)?", f"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa", "opensource org licenses ncsa", "ncsa", "ncsa"),
    ("wtfpl", f"(?:wtfpl|do what the fuck you want to public {_L})", f"(?:wtfpl|do what the fuck you want to public {_L})", "wtfpl", "wtfpl net", "wtfpl|want", "wtfpl|want"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense org", "unlicense", "unlicense"),
    ("cc0-1", "(?:cc0|creative commons zero)(?: 1 0)?", "(?:cc0 1 0|creative commons zero|cc0 universal)", "cc0 1 0", "creativecommons org publicdomain zero 1 0", "cc0|zero", "cc0|zero"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:nd|no ?derivatives|no ?derivs)(?: [1-4] [05])?", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by nc nd [1-4] [05]", "creativecommons org licenses by nc nd", "cc|commons", "cc|commons"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial) (?:sa|share ?alike)(?: [1-4] [05])?", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", "cc by nc sa [1-4] [05]", "creativecommons org licenses by nc sa", "cc|commons", "cc|commons"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)(?: [1-4] [05])?", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?", "cc by nc [1-4] [05]", "creativecommons org licenses by nc", "cc|commons", "cc|commons"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?derivatives|no ?derivs)(?: [1-4] [05])?", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] [05])?", "cc by nd [1-4] [05]", "creativecommons org licenses by nd", "cc|commons", "cc|commons"),
    ("cc-by-sa", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", "cc by sa [1-4] [05]", "creativecommons org licenses by sa", "cc|commons", "cc|commons"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?", f"(?:cc by [1-4] [05]|creative commons attribution(?: [1-4] [05])?(?: international)? {_L}|creative commons attribution [1-4] [05])", "cc by [1-4] [05]", "creativecommons org licenses by", "cc|commons", "cc|commons"),
    ("odbl-1", f"(?:odbl|open (?:data commons )?database {_L})", f"(?:odbl|open database {_L})", "odbl 1 0", "opendatacommons org licenses odbl", "odbl|database", "odbl|database"),
    ("odc-by-1", "(?:odc by|open data commons attribution)", f"open data commons attribution {_L}", "odc by 1 0", "opendatacommons org licenses by", "odc|commons", "commons"),
    ("pddl-1", "pddl", f"public domain dedication and {_L}", "pddl 1 0", "opendatacommons org licenses pddl", "pddl", "domain dedication"),
    ("ogl-uk-3", f"(?:ogl|open government {_L})", f"open government {_L}(?: {_V}[123](?: 0)?)?", "ogl uk [123] 0", "nationalarchives gov uk doc open government licence", "ogl|government", "government"),
    ("etalab-2", f"(?:etalab|licence ouverte)(?: {_V}2 0)?", "(?:etalab|licence) (?:licence )?ouverte", "etalab 2 0", "etalab gouv fr \\w*licence ouverte", "etalab|ouverte", "ouverte"),
    ("dl-de-by-2", "(?:dl de by|datenlizenz deutschland)", "datenlizenz deutschland", "dl de by 2 0", "govdata de dl de by 2 0", "dl|datenlizenz", "datenlizenz"),
    ("cecill", "cecill(?: [bc])?", f"cecill(?: [bc])? {_L}", "cecill(?: [bc]| 2 1)?", "cecill info licences", "cecill", "cecill"),
    ("mulan-2", f"mulan(?: psl| permissive software {_L})(?: {_V}2)?", f"mulan (?:psl|permissive software {_L})", "mulanpsl 2 0", "license coscl org cn mulanpsl2", "mulan", "mulan"),
    ("sspl-1", f"(?:sspl|server side public {_L})", f"server side public {_L}", "sspl 1 0", "mongodb com licensing server side public license", "sspl|server", "server side"),
    ("busl-1.1", f"(?:busl|bsl|business source {_L})(?: 1 1)?", f"business source {_L}(?: 1 1)?", "busl 1 1", "mariadb com bsl11", "busl|bsl|business", "business source"),
    ("elastic-2", f"elastic {_L}", f"elastic {_L}(?: 2 0)?", "elastic 2 0", "elastic co licensing elastic license", "elastic", f"elastic {_LW}"),
    ("polyform-nc", f"polyform noncommercial(?: {_L})?", f"polyform noncommercial(?: {_L})?", "polyform noncommercial 1 0 0", "polyformproject org licenses noncommercial", "polyform", "polyform"),
    ("openrail-m", f"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: {_L})?", f"(?:creativeml |bigscience |bigcode )?open ?rail m(?: {_L})?", "openrail(?: m)?", "huggingface co spaces \\w+ license", "openrail|rail", "openrail|rail"),
    ("llama", f"llama(?: [23](?: 1)?)? community {_L}", f"llama(?: [23](?: 1)?)? community {_L}", "llama [23]", "ai meta com llama license", "llama", "llama"),
    ("w3c", f"w3c(?: software(?: and document)?)?(?: notice and)? {_L}", f"w3c software(?: and document)?(?: notice and)? {_L}", "w3c", "w3 org consortium legal", "w3c", "w3c"),
    ("vim", f"vim {_L}", f"vim {_L}", "vim", "vimhelp org uganda txt", "vim", f"vim {_LW}"),
    ("zpl-2.1", f"(?:zpl|zope public {_L})", f"zope public {_L}", "zpl [12] [01]", "opensource org licenses zpl", "zpl|zope", "zope"),
    ("ecl-2", f"(?:ecl|educational community {_L})", f"educational community {_L}", "ecl [12] 0", "opensource org licenses ecl", "ecl|educational", "educational community"),
    ("beerware", f"beer ?ware {_L}", f"beer ?ware {_L}", "beerware", "people freebsd org phk", "beerware|ware", "beerware|ware"),
    ("blueoak-1", f"blue oak model {_L}", f"blue oak model {_L}", "blueoak 1 0 0", "blueoakcouncil org license", "oak", "oak"),
    ("cern-ohl-2", "cern(?: ohl| open hardware)", f"cern open hardware {_L}", "cern ohl [spw] 2 0", "ohwr org cern ohl", "cern", "cern"),
]
#: Sentences of licenses' own texts: label, rule, keywords.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font software) and associated documentation files", "hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "notice substantial"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", "fee hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions"),
    ("bsd-3", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse", "endorse neither"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache compliance"),
    ("apache-2", "you may obtain a copy of the license at https? www apache org licenses license 2 0", "apache obtain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu redistribute"),
    ("gpl-2", "either version 2 of the license or at your option any later version", "either option"),
    ("gpl-3", "either version 3 of the license or at your option any later version", "either option"),
    ("gpl", "you should have received a copy of the gnu general public license", "gnu received"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "gnu lesser"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu library"),
    ("agpl-3", "you should have received a copy of the gnu affero general public license", "gnu affero"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla subject"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "mozilla contents"),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "eclipse accompanying"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", "eclipse accompanying"),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "contents development"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost distributed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express liable"),
    ("zlib", "altered source versions must be plainly marked as such", "altered plainly"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0-1", "to the extent possible under law (?:\\S+ ){1,12}has waived all copyright and related or neighboring rights", "waived neighboring"),
    ("wtfpl", "you just do what the fuck you want to", "want just"),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document", "everyone verbatim"),
    ("openssl", "this product includes software developed by the openssl project", "openssl includes"),
    ("python-2", "python software foundation license version 2", "python foundation"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "sil font"),
    ("cc-by", "this work is licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?(?: international)? license", "commons work"),
    ("cc-by-sa", "this work is licensed under (?:a |the )?creative commons attribution share ?alike", "commons work"),
    ("cc-by-nc", "this work is licensed under (?:a |the )?creative commons attribution non ?commercial", "commons work"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized strictly"),
    ("proprietary", "proprietary and confidential", "proprietary confidential"),
    ("proprietary", "no part of this (?:publication|book|work|document) may be reproduced", "reproduced part"),
]
#: Remarks that name no license: label, rule, keywords.
REMARKS = [
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
    ("all-rights-reserved", "alle rechte vorbehalten", "rechte vorbehalten"),
    ("all-rights-reserved", "tous droits réservés", "droits réservés"),
    ("all-rights-reserved", "todos los derechos reservados", "derechos reservados"),
    ("public-domain", "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", "this (?:\\S+ )?is in the public domain", "public domain"),
    ("copyright", "copyright (?:c )?(?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", "copyright"),
    ("unknown-license", f"see (?:the )?{_L}(?: txt| md)? (?:file )?for (?:details|more information|licensing)", f"see {_LW}"),
    ("unknown-license", f"dual licen[cs]ed under", "dual"),
]
_VERBS = "licensed|licenced|released|distributed|available|published|covered|provided|governed|redistributed|lizenziert|veröffentlicht|publié|distribué|publicado|licenciado"
_GRANT = rf"(?:{_VERBS}) (?:in full |freely )?(?:(?:under|unter|sous|bajo)(?: (?:a|an|the|der|la|el|los))?(?: (?:terms|conditions)(?: and conditions)? of(?: the)?)?|by the (?:terms|conditions)(?: and conditions)? of(?: the)?)"


@dataclass(frozen=True)
class Rule:
    kind: str
    label: str
    pattern: str
    gate: tuple[frozenset[bytes], ...]


def _gate(words: str) -> tuple[frozenset[bytes], ...]:
    return tuple(frozenset(x.encode() for x in group.split("|")) for group in words.split())


def all_rules() -> list[Rule]:
    """Rules in order: of two detections of one kind over the same words the earlier rule's stays."""
    out = [Rule("base", label, phrase, _gate(phrase)) for label, phrase in BASE]
    out += [Rule("notice", *x[:2], _gate(x[2])) for x in NOTICES]
    out += [Rule("tag", f[0], f"spdx license identifier (?:\\S+ (?:and|or|with) )?{f[3]}", _gate("spdx identifier")) for f in FAMILIES]
    out += [Rule("grant", f[0], f"{_GRANT} (?:gnu )?(?:{f[1]})(?: {_L})?", _gate(f"{_VERBS} {f[5]}")) for f in FAMILIES]
    out += [Rule("address", f[0], f"https? (?:www )?{f[4]}", _gate(f"http|https {next(w for w in f[4].split() if w.isalnum())}")) for f in FAMILIES]
    out += [Rule("name", f[0], f[2], _gate(f[6])) for f in FAMILIES]
    return out + [Rule("remark", *x[:2], _gate(x[2])) for x in REMARKS]


_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters and what is beyond ASCII; A-Z lower-cased."""
    return text.translate(_BYTES).split()


def suppressed(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of (start, end, priority, rule) an earlier or longer one contains; priority 0 never is.

    Kind by kind, from the first: the furthest end among the intervals of earlier kinds that start no later is looked up;
    within a kind, intervals are walked by start, the longest first.
    """
    out = [False] * len(found)
    starts: list[int] = []
    reach: list[int] = []
    before: list[tuple[int, int]] = []
    for priority in sorted({x[2] for x in found}):
        own = sorted((k for k, x in enumerate(found) if x[2] == priority), key=lambda k: (found[k][0], -found[k][1], found[k][3]))
        furthest = -1
        for k in own:
            start, end = found[k][:2]
            at = bisect_right(starts, start) - 1
            out[k] = priority > 0 and (end <= furthest or at >= 0 and end <= reach[at])
            furthest = max(furthest, end)
        before = sorted(before + [found[k][:2] for k in own])
        starts, reach = [s for s, _ in before], list(accumulate((e for _, e in before), max))
    return out


class Scanner:
    """Detections of texts; gates can be left out, for tests."""

    def __init__(self, rules: Iterable[Rule] | None = None, gated: bool = True):
        self.rules = all_rules() if rules is None else list(rules)
        self.gated = gated
        self.compiled = [re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )") for r in self.rules]
        self.keywords = frozenset(w for r in self.rules for group in r.gate for w in group)

    def open(self, words: list[bytes]) -> list[int]:
        """Rules whose keywords a text has."""
        if not self.gated:
            return list(range(len(self.rules)))
        have = self.keywords.intersection(words)
        return [k for k, r in enumerate(self.rules) if all(not have.isdisjoint(group) for group in r.gate)] if have else []

    def __call__(self, words: list[bytes]) -> list[tuple[Rule, int, int]]:
        """Rule, first word and word after the last of each detection that stays, in order."""
        some = self.open(words)
        if not some:
            return []
        text = b" " + b" ".join(words) + b" "
        at = [1, *accumulate((len(w) + 1 for w in words), initial=1)][1:]
        found = [(bisect_right(at, m.start()) - 1, bisect_right(at, m.end()), _PRIORITY[self.rules[k].kind], k) for k in some for m in self.compiled[k].finditer(text)]
        gone = suppressed(found)
        return [(self.rules[k], start, end) for (start, end, _, k), lost in sorted(zip(found, gone, strict=True)) if not lost]


def score(found: list[tuple[Rule, int, int]]) -> float:
    """How sure it is that the text tells under which terms it stands: a noisy or over labels, each by its surest kind."""
    best: dict[str, float] = {}
    for rule, _, _ in found:
        best[rule.label] = max(best.get(rule.label, 0.0), KINDS[rule.kind])
    left = 1.0
    for label in sorted(best):
        left *= 1 - best[label]
    return 1 - left


_HIT = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("detections", pa.list_(_HIT))])
SCAN = "doc_id long, n_words long, score double, detections array<struct<kind: string, label: string, first_word: long, n_words: long, start: long, length: long>>"


def _places(text: bytes, found: list[tuple[Rule, int, int]]) -> list[tuple[int, int]]:
    """Start and length, in code points of the text, of each detection."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_BYTES))]
    wanted = sorted({x for _, start, end in found for x in (spans[start][0], spans[end - 1][1])})
    points, done, at = {}, 0, 0
    for x in wanted:
        done += len(text[at:x].decode("utf-8", "replace"))
        points[x], at = done, x
    return [(points[spans[start][0]], points[spans[end - 1][1]] - points[spans[start][0]]) for _, start, end in found]


def _scan(it):
    scanner = Scanner()
    for b in common.each(it):
        counts, scores, hits = [], [], []
        for text in common.texts(b.column("text")):
            words = words_of(text)
            found = scanner(words)
            counts.append(len(words))
            scores.append(score(found))
            spans = _places(text, found) if found else []
            hits.append([{"kind": r.kind, "label": r.label, "first_word": s, "n_words": e - s, "start": p, "length": n} for (r, s, e), (p, n) in zip(found, spans, strict=True)])
        yield common.batch(_SCAN, b.column("doc_id"), counts, scores, hits)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, score and detections (kind, label, place in words and in code points) of each row; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.map_arrow(rows, _scan, SCAN)


def digests(found: DataFrame) -> DataFrame:
    """Counts, places and labels of scanned() rows."""
    base = F.filter("detections", lambda d: d["kind"] == "base")
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"), "score",
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scanned(common.documents(spark, sf_dir)))
