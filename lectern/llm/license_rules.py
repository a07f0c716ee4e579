"""Signature rules of the license scan.

A rule is (name, label, priority, keyword, pattern). Patterns are written over
lower-case words with one space between them; ``compiled`` turns them into
expressions over text in which every word stands between two spaces of its own.
Lower priority numbers win.
"""

from __future__ import annotations

#: what a detection of each priority is worth
CONFIDENCE = [1.0, 0.95, 0.9, 0.8, 0.6]

#: label, keyword of the name, name, keyword of the identifier, identifier
LICENSES = [
    ("mit", "mit", "mit (?:open source )?licen[cs]e", "mit", "mit"),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?", "mit", "mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[cs]e (?:version |v )?1 1", "apache", "apache 1 1"),
    ("apache-2", "apache", "apache licen[cs]e (?:version |v )?2(?: 0)?", "apache", "apache 2 0"),
    ("bsd-2", "clause", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd", "bsd 2 clause"),
    ("bsd-3", "clause", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd", "bsd 3 clause"),
    ("bsd-4", "clause", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", "0bsd", "0bsd"),
    ("gpl-1", "general", "gnu general public licen[cs]e (?:version |v )?1(?: 0)?", "gpl", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general", "gnu general public licen[cs]e (?:version |v )?2(?: 0)?", "gpl", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general", "gnu general public licen[cs]e (?:version |v )?3(?: 0)?", "gpl", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "library", "gnu library general public licen[cs]e (?:version |v )?2(?: 0)?", "lgpl", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "gnu lesser general public licen[cs]e (?:version |v )?2 1", "lgpl", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser", "gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?", "lgpl", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", "gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?", "agpl", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", "gfdl", "gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v )?1 1", "mpl", "mpl 1 1"),
    ("mpl-2", "mozilla", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?", "mpl", "mpl 2 0"),
    ("epl-1", "eclipse", "eclipse public licen[cs]e (?:version |v )?1(?: 0)?", "epl", "epl 1 0"),
    ("epl-2", "eclipse", "eclipse public licen[cs]e (?:version |v )?2(?: 0)?", "epl", "epl 2 0"),
    ("cddl", "common", "common development and distribution licen[cs]e", "cddl", "cddl 1 [01]"),
    ("cpl-1", "common", "common public licen[cs]e", "cpl", "cpl 1 0"),
    ("eupl", "european", "european union public licen[cs]e", "eupl", "eupl 1 [012]"),
    ("isc", "isc", "isc licen[cs]e", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "zlib"),
    ("libpng", "libpng", "libpng licen[cs]e", "libpng", "libpng 2 0"),
    ("bsl-1", "boost", "boost software licen[cs]e", "bsl", "bsl 1 0"),
    ("busl", "business", "business source licen[cs]e", "busl", "busl 1 1"),
    ("sspl", "side", "server side public licen[cs]e", "sspl", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic licen[cs]e", "elastic", "elastic 2 0"),
    ("artistic-2", "artistic", "artistic licen[cs]e", "artistic", "artistic 2 0"),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", "wtfpl", "wtfpl"),
    ("python-2", "python", "python software foundation licen[cs]e", "python", "python 2 0"),
    ("php-3", "php", "php licen[cs]e", "php", "php 3 01"),
    ("ruby", "ruby", "ruby licen[cs]e", "ruby", "ruby"),
    ("openssl", "openssl", "openssl licen[cs]e", "openssl", "openssl"),
    ("ofl", "sil", "sil open font licen[cs]e", "ofl", "ofl 1 [01]"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "ms", "ms pl"),
    ("odbl", "database", "open (?:data commons open )?database licen[cs]e", "odbl", "odbl 1 0"),
    ("pddl", "dedication", "public domain dedication and licen[cs]e", "pddl", "pddl 1 0"),
    ("cc0", "creative", "creative commons (?:zero|cc0|public domain dedication)", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "creative", "creative commons attribution(?: licen[cs]e)?(?: (?:version |v )?[1-4] [05])?", "cc", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", "sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives", "nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial", "nc", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "noncommercial", "creative commons attribution noncommercial sharealike", "nc", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "noncommercial", "creative commons attribution noncommercial noderivatives", "nc", "cc by nc nd(?: [1-4] [05])?"),
]

GRANT = "(?:licen[cs]ed|released|distributed|published|available|provided|shared|offered)"
THING = "(?:work|software|project|file|program|package|library|document|code|text|page|dataset|material|content)"

#: form, priority, which keyword, pattern with {name} and {id}
FORMS = [
    ("identifier", 0, "id", "spdx licen[cs]e identifier (?:{id})"),
    ("statement", 1, "name", "(?:this|the) " + THING + " is " + GRANT + " under (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    ("grant", 2, "name", GRANT + " under (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    ("grant-id", 2, "id", GRANT + " under (?:the )?(?:terms of (?:the )?)?(?:{id})(?: licen[cs]e)?"),
    ("title", 3, "name", "(?:{name})"),
    ("mention", 4, "id", "(?:under|licen[cs]e) (?:the )?(?:{id})"),
]

#: rules that name no single license
GENERIC = [
    ("all-rights", "all-rights-reserved", 3, "reserved", "all rights reserved"),
    ("public-domain", "public-domain", 3, "domain", "(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("cc-by-nc-short", "cc-by-nc", 4, "nc", "cc by nc"),
    ("cc-by-short", "cc-by", 4, "by", "cc by"),
]

#: notices and bodies: what files and license texts say themselves; name, label, priority, needed word, pattern
NOTICES = [
    ("gpl-header-1", "gpl-1", 1, "general", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 1"),
    ("gpl-header-2", "gpl-2", 1, "general", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2"),
    ("gpl-header-3", "gpl-3", 1, "general", "gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl-header-2", "lgpl-2", 1, "library", "gnu library general public licen[cs]e as published by the free software foundation (?:either )?version 2"),
    ("lgpl-header-2.1", "lgpl-2.1", 1, "lesser", "gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-header-3", "lgpl-3", 1, "lesser", "gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("agpl-header-3", "agpl-3", 1, "affero", "gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3"),
    ("gfdl-header", "gfdl", 1, "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("apache-header-2", "apache-2", 1, "apache", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
    ("asf-header", "apache-2", 1, "apache", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("mpl-header-1.1", "mpl-1.1", 1, "mozilla", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-header-2", "mpl-2", 1, "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0"),
    ("epl-header-1", "epl-1", 1, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0"),
    ("epl-header-2", "epl-2", 1, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?2 0"),
    ("cddl-header", "cddl", 1, "common", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("mit-body", "mit", 2, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-condition", "mit", 3, "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc-body", "isc", 2, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd-body", "0bsd", 1, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-body", "bsd", 3, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "bsd-3", 2, "endorse", "neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "bsd-4", 2, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-style-file", "bsd", 3, "bsd", "governed by a bsd style licen[cs]e that can be found in the licen[cs]e file"),
    ("zlib-body", "zlib", 2, "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-body", "bsl-1", 2, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-header", "bsl-1", 1, "boost", "distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense-body", "unlicense", 2, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-body", "cc0", 2, "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("artistic-body", "artistic-2", 2, "artistic", "the artistic licen[cs]e 2 0 copyright"),
    ("apache-body-2", "apache-2", 2, "licensor", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the licen[cs]e"),
    ("gpl-preamble", "gpl", 3, "freedom", "the gnu general public licen[cs]e is intended to guarantee your freedom to share and change"),
    ("ofl-body", "ofl", 2, "font", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("proprietary", "proprietary", 3, "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("no-redistribution", "proprietary", 3, "unauthorized", "unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document)(?: via any medium)? is strictly prohibited"),
]

#: words of which every match of a name holds one, where the keyword is not in every match
ALSO = {"bsd-2": ["bsd", "freebsd"], "bsd-3": ["bsd"], "bsd-4": ["bsd"]}

#: every rule needs one of these somewhere in the raw text
GATE = (
    r"[Ll][Ii][Cc][Ee][Nn][CSces]|[Ss][Pp][Dd][Xx]|[Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd]|[Dd][Oo][Mm][Aa][Ii][Nn]"
    r"|[Pp][Ee][Rr][Mm][Ii][SsTt]|[Ee][Nn][Dd][Oo][Rr][Ss][Ee]|[Aa][Dd][Vv][Ee][Rr][Tt][Ii][Ss][Ii][Nn][Gg]|[Aa][Ll][Tt][Ee][Rr][Ee][Dd]"
    r"|[Ww][Aa][Ii][Vv][Ee][Dd]|[Ff][Oo][Nn][Tt]|[Pp][Rr][Oo][Pp][Rr][Ii][Ee][Tt][Aa][Rr][Yy]|[Uu][Nn][Aa][Uu][Tt][Hh][Oo][Rr][Ii][Zz][Ee][Dd]"
    r"|[Bb][Ss][Dd]|[Aa][Tt][Tt][Rr][Ii][Bb][Uu][Tt][Ii][Oo][Nn]"
    r"|[Cc][Rr][Ee][Aa][Tt][Ii][Vv][Ee]|[Cc][Cc][\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[Bb][Yy]"
    r"|(?:^|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])[Uu][Nn][Dd][Ee][Rr][\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
)


def compiled(pattern: str) -> str:
    """Every word stands between spaces of its own, so neighbours never share one."""
    return " " + pattern.replace(" ", "  ") + " "


def rules() -> list[dict]:
    """All rules, in the order that settles equal detections."""
    out = []
    for form, priority, which, pattern in FORMS:
        for label, name_key, name, id_key, ident in LICENSES:
            out.append({
                "name": f"{form}:{label}", "label": label, "priority": priority,
                "keyword": name_key if which == "name" else id_key,
                "needs": ALSO.get(label, [name_key]) if which == "name" else [id_key],
                "pattern": compiled(pattern.format(name=name, id=ident)),
            })
    out += [
        {"name": f"generic:{n}", "label": label, "priority": p, "keyword": k, "needs": [k], "pattern": compiled(pat)}
        for n, label, p, k, pat in GENERIC
    ] + [
        {"name": f"notice:{n}", "label": label, "priority": p, "keyword": k, "needs": [k], "pattern": compiled(pat)}
        for n, label, p, k, pat in NOTICES
    ]
    return [r | {"rank": i} for i, r in enumerate(out)]
