"""Signature rules of the licence scan, in order of priority.

Each rule is (label, priority, keyword, pattern, weight): the pattern is tried only where its
keyword occurs in the lower-cased text. Lower priority numbers win over higher ones.
"""

from __future__ import annotations

# name in running text (a pattern), label, keyword of the name
NAMED = [
    (r"apache(?: software)? licen[sc]e,?(?: version| v\.?)? ?2(?:\.0)?", "apache-2.0", "apache"), (r"apache(?: software)? licen[sc]e,?(?: version| v\.?)? ?1\.1", "apache-1.1", "apache"), (r"apache-2\.0", "apache-2.0", "apache"),
    (r"mit licen[sc]e", "mit", "mit"), (r"expat licen[sc]e", "mit", "expat"), (r"x11 licen[sc]e", "x11", "x11"), (r"mit[- ]0\b", "mit-0", "mit"),
    (r"(?:3|three)[- ]clause bsd", "bsd-3-clause", "clause"), (r"bsd[- ](?:3|three)[- ]clause", "bsd-3-clause", "clause"), (r"new bsd licen[sc]e", "bsd-3-clause", "bsd"), (r"modified bsd licen[sc]e", "bsd-3-clause", "bsd"),
    (r"(?:2|two)[- ]clause bsd", "bsd-2-clause", "clause"), (r"bsd[- ](?:2|two)[- ]clause", "bsd-2-clause", "clause"), (r"simplified bsd licen[sc]e", "bsd-2-clause", "bsd"), (r"freebsd licen[sc]e", "bsd-2-clause", "freebsd"),
    (r"(?:4|four)[- ]clause bsd", "bsd-4-clause", "clause"), (r"bsd[- ](?:4|four)[- ]clause", "bsd-4-clause", "clause"), (r"original bsd licen[sc]e", "bsd-4-clause", "bsd"), (r"(?:zero|0)[- ]?clause bsd", "0bsd", "bsd"), (r"0bsd", "0bsd", "0bsd"), (r"bsd[- ](?:style )?licen[sc]e", "bsd", "bsd"),
    (r"gnu affero general public licen[sc]e(?: version| v\.?)? ?3", "agpl-3.0", "affero"), (r"affero general public licen[sc]e", "agpl", "affero"), (r"agpl[- ]?v?3", "agpl-3.0", "agpl"), (r"agpl", "agpl", "agpl"),
    (r"gnu (?:lesser|library) general public licen[sc]e,?(?: version| v\.?)? ?3", "lgpl-3.0", "general public"), (r"gnu (?:lesser|library) general public licen[sc]e,?(?: version| v\.?)? ?2\.1", "lgpl-2.1", "general public"), (r"gnu (?:lesser|library) general public licen[sc]e", "lgpl", "general public"),
    (r"lgpl[- ]?v?3", "lgpl-3.0", "lgpl"), (r"lgpl[- ]?v?2\.1", "lgpl-2.1", "lgpl"), (r"lgpl[- ]?v?2", "lgpl-2.0", "lgpl"), (r"lgpl", "lgpl", "lgpl"),
    (r"gnu general public licen[sc]e,?(?: version| v\.?)? ?3", "gpl-3.0", "general public"), (r"gnu general public licen[sc]e,?(?: version| v\.?)? ?2", "gpl-2.0", "general public"), (r"gnu general public licen[sc]e", "gpl", "general public"), (r"general public licen[sc]e", "gpl", "general public"),
    (r"gpl[- ]?v?3", "gpl-3.0", "gpl"), (r"gpl[- ]?v?2", "gpl-2.0", "gpl"), (r"gnu gpl", "gpl", "gpl"), (r"gnu free documentation licen[sc]e", "gfdl", "free documentation"), (r"gfdl", "gfdl", "gfdl"),
    (r"mozilla public licen[sc]e,?(?: version| v\.?)? ?2", "mpl-2.0", "mozilla"), (r"mozilla public licen[sc]e,?(?: version| v\.?)? ?1\.1", "mpl-1.1", "mozilla"), (r"mozilla public licen[sc]e", "mpl", "mozilla"), (r"mpl[- ]?2\.0", "mpl-2.0", "mpl"),
    (r"eclipse public licen[sc]e,?(?: version| -? ?v\.?)? ?2", "epl-2.0", "eclipse"), (r"eclipse public licen[sc]e,?(?: version| -? ?v\.?)? ?1", "epl-1.0", "eclipse"), (r"eclipse public licen[sc]e", "epl", "eclipse"), (r"epl[- ]?2\.0", "epl-2.0", "epl"),
    (r"eclipse distribution licen[sc]e", "edl-1.0", "eclipse"), (r"common development and distribution licen[sc]e", "cddl", "common development"), (r"cddl[- ]?1\.[01]", "cddl", "cddl"), (r"common public licen[sc]e", "cpl-1.0", "common public"), (r"ibm public licen[sc]e", "ipl-1.0", "ibm"),
    (r"boost software licen[sc]e", "bsl-1.0", "boost"), (r"isc licen[sc]e", "isc", "isc"), (r"zlib licen[sc]e", "zlib", "zlib"), (r"zlib/libpng licen[sc]e", "zlib", "libpng"), (r"libpng licen[sc]e", "libpng", "libpng"), (r"unlicense", "unlicense", "unlicense"), (r"wtfpl", "wtfpl", "wtfpl"), (r"do what the f\w* you want to public licen[sc]e", "wtfpl", "you want to"),
    (r"artistic licen[sc]e,?(?: version| v\.?)? ?2", "artistic-2.0", "artistic"), (r"artistic licen[sc]e", "artistic", "artistic"), (r"perl licen[sc]e", "artistic", "perl"), (r"python software foundation licen[sc]e", "psf-2.0", "python"), (r"psf licen[sc]e", "psf-2.0", "psf"), (r"php licen[sc]e", "php", "php"), (r"ruby licen[sc]e", "ruby", "ruby"),
    (r"openssl licen[sc]e", "openssl", "openssl"), (r"postgresql licen[sc]e", "postgresql", "postgresql"), (r"curl licen[sc]e", "curl", "curl"), (r"ncsa open source licen[sc]e", "ncsa", "ncsa"), (r"university of illinois/ncsa", "ncsa", "ncsa"), (r"microsoft public licen[sc]e", "ms-pl", "microsoft"), (r"microsoft reciprocal licen[sc]e", "ms-rl", "microsoft"),
    (r"open software licen[sc]e", "osl-3.0", "open software"), (r"academic free licen[sc]e", "afl-3.0", "academic free"), (r"european union public licen[sc]e", "eupl", "european union"), (r"eupl", "eupl", "eupl"), (r"cecill", "cecill", "cecill"), (r"q public licen[sc]e", "qpl-1.0", "q public"), (r"sleepycat licen[sc]e", "sleepycat", "sleepycat"),
    (r"sil open font licen[sc]e", "ofl-1.1", "open font"), (r"open font licen[sc]e", "ofl-1.1", "open font"), (r"ubuntu font licen[sc]e", "ubuntu-font", "ubuntu"), (r"bitstream vera", "bitstream-vera", "bitstream"), (r"open data commons open database licen[sc]e", "odbl", "open data"), (r"open database licen[sc]e", "odbl", "open database"), (r"odbl", "odbl", "odbl"),
    (r"open data commons attribution licen[sc]e", "odc-by", "open data"), (r"public domain dedication and licen[sc]e", "pddl", "public domain"), (r"server side public licen[sc]e", "sspl", "server side"), (r"sspl", "sspl", "sspl"), (r"business source licen[sc]e", "busl-1.1", "business source"), (r"elastic licen[sc]e", "elastic-2.0", "elastic"), (r"commons clause", "commons-clause", "commons clause"),
    (r"polyform noncommercial", "polyform-nc", "polyform"), (r"polyform small business", "polyform-sb", "polyform"), (r"blue oak model licen[sc]e", "blueoak-1.0.0", "blue oak"), (r"mulan permissive software licen[sc]e", "mulanpsl", "mulan"), (r"upl-1\.0", "upl-1.0", "upl"), (r"universal permissive licen[sc]e", "upl-1.0", "universal permissive"), (r"w3c software notice", "w3c", "w3c"),
    (r"hippocratic licen[sc]e", "hippocratic", "hippocratic"), (r"openrail", "openrail", "openrail"), (r"llama \d? ?community licen[sc]e", "llama", "llama"), (r"json licen[sc]e", "json", "json"), (r"beerware", "beerware", "beerware"), (r"zope public licen[sc]e", "zpl", "zope"), (r"sun industry standards source licen[sc]e", "sissl", "sun industry"), (r"vim licen[sc]e", "vim", "vim"),
    (r"tex live", "tex", "tex live"), (r"latex project public licen[sc]e", "lppl", "latex"), (r"lppl", "lppl", "lppl"), (r"apple public source licen[sc]e", "apsl", "apple"), (r"nasa open source agreement", "nosa", "nasa"), (r"intel open source licen[sc]e", "intel", "intel"), (r"lucent public licen[sc]e", "lpl", "lucent"), (r"nokia open source licen[sc]e", "nokia", "nokia"), (r"reciprocal public licen[sc]e", "rpl", "reciprocal"),
    (r"ricoh source code public licen[sc]e", "rscpl", "ricoh"), (r"fair licen[sc]e", "fair", "fair"), (r"motosoto open source licen[sc]e", "motosoto", "motosoto"), (r"naumen public licen[sc]e", "naumen", "naumen"), (r"open group test suite licen[sc]e", "ogtsl", "open group"), (r"vovida software licen[sc]e", "vsl", "vovida"), (r"xnet licen[sc]e", "xnet", "xnet"), (r"entessa public licen[sc]e", "entessa", "entessa"),
    (r"educational community licen[sc]e", "ecl-2.0", "educational"), (r"attribution assurance licen[sc]e", "aal", "assurance"), (r"adaptive public licen[sc]e", "apl-1.0", "adaptive"), (r"frameworx(?: open)? licen[sc]e", "frameworx", "frameworx"), (r"watcom", "watcom", "watcom"), (r"unicode licen[sc]e", "unicode", "unicode"), (r"info-zip licen[sc]e", "info-zip", "info-zip"), (r"independent jpeg group", "ijg", "jpeg group"),
]
CC = [(parts, parts.replace(" ", "-")) for parts in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")]
CC_WORDS = {"by": "attribution", "sa": "share[- ]?alike", "nd": "no[- ]?deriv(?:ative)?s?", "nc": "non[- ]?commercial"}
SPDX = "0bsd aal afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-2.0 gpl-3.0 ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 qpl-1.0 ruby sleepycat sspl-1.0 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
URLS = [
    ("apache.org/licenses/license-2.0", "apache-2.0"), ("opensource.org/licenses/mit", "mit"), ("opensource.org/licenses/bsd-3-clause", "bsd-3-clause"), ("opensource.org/licenses/bsd-2-clause", "bsd-2-clause"), ("opensource.org/licenses/isc", "isc"), ("opensource.org/licenses/artistic-2.0", "artistic-2.0"), ("opensource.org/licenses/mpl-2.0", "mpl-2.0"), ("mozilla.org/mpl/2.0", "mpl-2.0"),
    ("gnu.org/licenses/gpl-3.0", "gpl-3.0"), ("gnu.org/licenses/gpl-2.0", "gpl-2.0"), ("gnu.org/licenses/lgpl-3.0", "lgpl-3.0"), ("gnu.org/licenses/lgpl-2.1", "lgpl-2.1"), ("gnu.org/licenses/agpl-3.0", "agpl-3.0"), ("gnu.org/licenses/fdl", "gfdl"), ("gnu.org/licenses", "gpl"), ("boost.org/license_1_0", "bsl-1.0"), ("eclipse.org/legal/epl-2.0", "epl-2.0"), ("eclipse.org/legal/epl-v10", "epl-1.0"), ("unlicense.org", "unlicense"), ("scripts.sil.org/ofl", "ofl-1.1"), ("wtfpl.net", "wtfpl"), ("opendatacommons.org/licenses/odbl", "odbl"), ("opendatacommons.org/licenses/by", "odc-by"), ("opendatacommons.org/licenses/pddl", "pddl"),
    ("creativecommons.org/publicdomain/zero", "cc0"), ("creativecommons.org/publicdomain/mark", "public-domain"), ("creativecommons.org/licenses/by-nc-nd", "cc-by-nc-nd"), ("creativecommons.org/licenses/by-nc-sa", "cc-by-nc-sa"), ("creativecommons.org/licenses/by-nc", "cc-by-nc"), ("creativecommons.org/licenses/by-nd", "cc-by-nd"), ("creativecommons.org/licenses/by-sa", "cc-by-sa"), ("creativecommons.org/licenses/by", "cc-by"),
]
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.99), ("isc", "permission to use, copy", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee", 0.95), ("0bsd", "with or without fee", r"for any purpose with or without fee is hereby granted\.", 0.6),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.97), ("bsd-3-clause", "endorse or promote", r"neither the names? of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote", 0.95), ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 0.95), ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.95),
    ("apache-2.0", "apache", r"licensed under the apache licen[sc]e", 0.97), ("gpl", "redistribute it and/or", r"you can redistribute it and/or modify it under the terms of the gnu general public", 0.98), ("lgpl", "redistribute it and/or", r"you can redistribute it and/or modify it under the terms of the gnu lesser", 0.98), ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public", 0.98), ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 0.98),
    ("bsl-1.0", "boost software", r"distributed under the boost software licen[sc]e", 0.97), ("public-domain", "public domain", r"(?:released|placed|dedicated)(?: in)?to the public domain", 0.9), ("public-domain", "public domain", r"in the public domain", 0.7), ("cc0", "cc0", r"\bcc0\b", 0.9), ("cc0", "no rights reserved", r"no rights reserved", 0.8), ("proprietary", "proprietary and confidential", r"proprietary and confidential", 0.9), ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", 0.85), ("proprietary", "trade secret", r"(?:contains|constitutes?) trade secrets?", 0.7),
    ("proprietary", "without permission", r"(?:not|nor) (?:be )?(?:reproduced|copied|distributed) without (?:prior )?(?:written )?permission", 0.8), ("reserved", "rights reserved", r"(?:all|tous|alle|todos) rights reserved", 0.6), ("reserved", "droits", r"tous droits r[ée]serv[ée]s", 0.6), ("reserved", "rechte", r"alle rechte vorbehalten", 0.6), ("reserved", "derechos", r"todos los derechos reservados", 0.6), ("reserved", "some rights", r"some rights reserved", 0.5),
    ("copyright", "copyright", r"copyright (?:\(c\)|©|\d{4})", 0.5), ("copyright", "©", r"© ?(?:\d{4}|[a-z])", 0.5), ("copyright", "(c)", r"\(c\) ?\d{4}", 0.4), ("warranty-disclaimer", "warranty", r"without warranty of any kind", 0.4), ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind", 0.4), ("warranty-disclaimer", "provided", r"provided [\"'“]?as is", 0.4), ("dual", "dual", r"dual[- ]licen[sc]ed", 0.5), ("open-access", "open access", r"open access article", 0.6), ("fair-use", "fair use", r"fair use", 0.3),
]


def rules() -> list[tuple[str, int, str, str, float]]:
    out = [(x, 0, "spdx-license-identifier", rf"spdx-license-identifier:\s*{x.replace('.', chr(92) + '.')}(?:-only|-or-later|\+)?(?![\w.-])", 1.0) for x in SPDX]
    out += [(x, 1, kw.partition("/")[0], kw.replace(".", r"\."), 0.95) for kw, x in URLS]
    out += [(x, 2, kw, p, w) for x, kw, p, w in TEXTS if w >= 0.9]
    for parts, tail in sorted(CC, key=lambda x: -len(x[0])):
        words = r",? ?(?:[-–] ?)?(?:and )?".join(CC_WORDS[p] for p in parts.split())
        out.append((f"cc-{tail}", 3, "creative commons", rf"creative commons {words}", 0.95))
        out.append((f"cc-{tail}", 3, "cc", rf"(?<!\w)cc[ -]{'[ -]'.join(parts.split())}(?:[ -]?v?\d(?:\.\d)?)?(?![\w-])", 0.9))
    out += [("cc", 5, "creative commons", r"creative commons", 0.6)]
    for i, (p, x, kw) in enumerate(NAMED):
        out.append((x, 3, kw, rf"(?:licensed|released|distributed|available|published|covered)(?: \w+){{0,3}} under (?:the )?(?:terms of )?(?:the )?{p}", 0.95))
        out.append((x, 4, kw, rf"(?<!\w){p}(?!\w)", 0.7))
    return out + [(x, 5, kw, p, w) for x, kw, p, w in TEXTS if w < 0.9]
