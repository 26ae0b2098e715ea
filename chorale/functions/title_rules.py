"""Ordered rules that cut artist and song out of a title. The order decides; patterns and weights are fixed values.

A rule is (name, pattern, artist groups, song group, confidence); several artist groups are joined by
blanks. A rule in `SPLITS` has one group that holds both and is cut by the patterns given there. All
patterns are matched without case.
"""

from __future__ import annotations

DASH = r"\s*[-–—]\s*"

Rule = tuple[str, str, tuple[int, ...], int, float]

# Patterns, places and weights of the rules for all titles, in the order in which they are tried.
CORE: list[Rule] = [
    ("german_numbered", r"^DE\s+(.+?)\s+\d{4,}$", (), 0, 0.85),
    ("last_first", rf"^([^,]+),\s*([^-]+){DASH}([^(]+?)\s*\([^)]*karaoke[^)]*\)", (2, 1), 3, 0.95),
    ("song_karaoke_artist", rf"^([^(]+?)\s*\(karaoke\){DASH}(.+)$", (2,), 1, 0.95),
    ("song_slash_artist", r"^([^/]+?)\s*/\s*([^(]+?)\s*\([^)]*karaoke[^)]*\)", (2,), 1, 0.95),
    ("no_separator", r"^(.+?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s*\(karaoke\)(?:\s*#\d+)?$", (2,), 1, 0.75),
    ("song_artist_pipe_karaoke", rf"^([^-]+?){DASH}([^|]+?)\s*\|.*karaoke", (2,), 1, 0.92),
    ("song_parens_artist_pipe", rf"^([^-]+?\([^)]+?\)[^-]*?){DASH}([^|]+?)\s*\|", (2,), 1, 0.91),
    ("artist_song_pipe", rf"^([^-|]+?){DASH}([^|]+?)\s*\|", (1,), 2, 0.85),
    ("dots", r"^([^•]+?)\s*•\s*([^•]+?)\s*•\s*karaoke", (1,), 2, 0.95),
    ("karaoke_song_artist_star", rf"^karaoke\s+([^-]+?){DASH}([^*]+?)\s*\*", (2,), 1, 0.95),
    ("karaoke_song_artist", rf"^karaoke\s+(.+?){DASH}(.+)$", (2,), 1, 0.85),
    ("quoted_artist_song", rf'^"([^"]+)"{DASH}"([^"]+)"\s*\([^)]*karaoke[^)]*\)', (1,), 2, 0.95),
    ("karaoke_quoted", rf'^karaoke\s*:?\s*"([^"]+)"{DASH}"([^"]+)"', (2,), 1, 0.95),
    ("quoted_style_of", r'^"([^"]+)"\s*\([^)]*style\s+of\s+"([^"]+)"[^)]*\)', (2,), 1, 0.9),
    ("channel_quoted_style_of", rf'^([^-]+){DASH}"([^"]+)"\s*\([^)]*style\s+of\s+"([^"]+)"[^)]*\)', (3,), 2, 0.9),
    ("channel_quoted_artist_song", rf'^([^-]+){DASH}"([^"]+)"{DASH}"([^"]+)"\s*\([^)]*karaoke[^)]*\)', (2,), 3, 0.85),
    ("quoted_run", r'^"([^"]+)"-"([^"]+)"\s*(?:"[^"]*")*\s*\([^)]*karaoke[^)]*\)', (1,), 2, 0.85),
    ("quoted_three", rf'^"([^"]+)"{DASH}"([^"]+)"{DASH}"[^"]*karaoke[^"]*"', (1,), 2, 0.9),
    ("bracket_karaoke", r"^\[[^\]]*karaoke[^\]]*\]\s*([^-–—]+)[-–—]([^\[\]]+)\s*\[[^\]]*\]", (1,), 2, 0.9),
    ("bracket_end", r"^\[[^\]]*\]\s*([^-–—]+)[-–—]([^\[\]]+)\s*\[[^\]]*karaoke[^\]]*\]", (1,), 2, 0.85),
    ("song_artist_karaoke_end", rf"^([^-–—]+?){DASH}([^(\[\]]+?)\s*\([^)]*karaoke[^)]*\)$", (2,), 1, 0.82),
    ("song_artist_karaoke_word", rf"^([^-–—]+?){DASH}([^(\[\]|]+?)\s*karaoke\s*$", (2,), 1, 0.82),
    ("artist_song_karaoke", rf"^([^-–—]+?){DASH}([^(\[\]]+?)\s*\([^)]*karaoke[^)]*\)", (1,), 2, 0.8),
    ("style_of", r"^([^(]+?)\s*\([^)]*style\s+of\s+([^)]+?)\)", (2,), 1, 0.75),
    ("song_by_artist", r"^([^(]+?)\s+by\s+([^(]+?)\s*\([^)]*karaoke[^)]*\)", (2,), 1, 0.75),
    ("known_artist", r"^(helene fischer|unheilig|beatrice egli|peter wackel|andrea berg|gregor meyle)\s+(.+)$", (1,), 2, 0.75),
    ("hyphenated_song", r"^([a-zA-Z]+(?:\s+[a-zA-Z]+)*-[a-zA-Z]+)\s*\(", (), 1, 0.75),
    ("dash", rf"^([^-–—]+?){DASH}([^(\[\]]+)(?:\s*[(\[][^)\]]*karaoke[^)\]]*[)\]])?", (1,), 2, 0.6),
    ("blank_between", r"^([a-zA-Z\s]+?)\s+([a-zA-Z\s]{3,}?)$", (1,), 2, 0.5),
    ("song_only", r"^([^(]+?)\s*\([^)]*karaoke[^)]*\)", (), 1, 0.5),
]

_ARTICLE = "(?:the|a|an|der|die|das|ein|eine)"
#: How the one group of a rule comes apart: the first pattern that fits gives artist and song. Fixed values.
SPLITS: dict[str, list[str]] = {
    "german_numbered": [
        r"^(helene fischer|sarah lombardi|andrea berg|beatrice egli|unheilig|peter wackel|gregor meyle|de toppers|german nursery rhyme|the little mermaid)\s*(.*)$",
        r"^(\S+(?:\s+\S+)*?\s+(?:film|movie))\b\s*(.*)$",
        rf"^({_ARTICLE}\s+\S+)\s+({_ARTICLE}\s+.+)$",
        rf"^({_ARTICLE}\s+\S+\s+\S+)\s+(.+)$",
        r"^(\S+\s+\S+)\s+(.+)$",
        r"^(\S+)\s+(\S+)$",
        r"^(\S+)()$",
    ]
}

#: By script of the title, as told by chorale.functions.strings.script. Fixed values.
BY_SCRIPT: dict[str, list[Rule]] = {
    "korean": [("korean_bracket", r"^\[[^\]]*가라오케[^\]]*\]\s*([^-–—]+)[-–—]([^\[\]]+)", (1,), 2, 0.9), ("korean_standard", r"^([^-–—]+)[-–—]([^(]+)\s*\([^)]*가라오케[^)]*\)", (1,), 2, 0.85)],
    "japanese": [("japanese_bracket", r"^\[[^\]]*カラオケ[^\]]*\]\s*([^-–—]+)[-–—]([^\[\]]+)", (1,), 2, 0.9), ("japanese_standard", r"^([^-–—]+)[-–—]([^(]+)\s*\([^)]*カラオケ[^)]*\)", (1,), 2, 0.85)],
    "chinese": [("chinese_bracket", r"^\[[^\]]*卡拉OK[^\]]*\]\s*([^-–—]+)[-–—]([^\[\]]+)", (1,), 2, 0.9), ("chinese_standard", r"^([^-–—]+)[-–—]([^(]+)\s*\([^)]*卡拉OK[^)]*\)", (1,), 2, 0.85)],
}

#: Kind of channel, what its name (in lower case) must match, and its rules; the first kind that applies. Fixed values.
BY_CHANNEL: list[tuple[str, str, list[Rule]]] = [
    ("last_name_first", "let'?s sing karaoke", [("channel_last_first", rf"^([^,]+),\s*([^-]+){DASH}([^(]+?)\s*\([^)]*karaoke[^)]*\)", (2, 1), 3, 0.95)]),
    ("dotted", "lugn", [("channel_dots", r"^([^•]+?)\s*•\s*([^•]+?)\s*•\s*karaoke", (1,), 2, 0.95)]),
    ("starred", "karafun", [("channel_star", rf"^karaoke\s+([^-]+?){DASH}([^*]+?)\s*\*", (2,), 1, 0.95)]),
    (
        "named_first",
        "sing king",
        [
            ("channel_named_style", rf'^sing king karaoke{DASH}"([^"]+)"\s*\([^)]*style\s+of\s+"([^"]+)"[^)]*\)', (2,), 1, 0.95),
            ("channel_named_song", r"^sing king.*?[-–—]\s*([^(]+?)\s*\([^)]*karaoke[^)]*\)", (), 1, 0.8),
        ],
    ),
    (
        "named_last",
        "zoom.*karaoke|karaoke.*zoom",
        [
            ("channel_three_quoted", rf'^"([^"]+)"{DASH}"([^"]+)"{DASH}"[^"]*zoom\s*karaoke[^"]*"', (1,), 2, 0.9),
            ("channel_three", rf"^([^-–—]+){DASH}([^-–—]+){DASH}.*?zoom\s*karaoke", (1,), 2, 0.8),
        ],
    ),
]

#: Rules that name the channel: {} stands for the channel's own name as written. Fixed values.
BRANDED: list[Rule] = [
    ("branded_quoted", r"^{}[:\s]*[\"']([^\"']+)[\"']\s*[-–—]\s*[\"']([^\"']+)[\"']", (1,), 2, 0.9),
    ("branded_bracket", r"^\[{}\]\s*([^-–—]+)[-–—](.+)", (1,), 2, 0.85),
    ("branded_dashes", r"^{}\s*[-–—]\s*(.+?)\s*[-–—]\s*(.+?)\s*\([^)]*karaoke[^)]*\)", (1,), 2, 0.8),
]
#: Further rules of the template pass, and those for titles of karaoke channels; a weight of the latter counts a tenth more, up to 0.95. Fixed values.
TEMPLATES: list[Rule] = [
    ("from_quoted", r'^(.+?)\s*[-–—]\s*(.+?)\s+from\s+"([^"]+)"(?:\s*\(karaoke[^)]*\))?$', (1,), 2, 0.7),
    ("from_quoted_parens", r'^(.+?)\s*[-–—]\s*(.+?)\s*\(from\s+"([^"]+)"\)(?:\s*\(karaoke[^)]*\))?$', (1,), 2, 0.7),
    ("two_quoted_karaoke", r'^"([^"]+)"\s*[-–—]\s*"([^"]+)"\s*[-–—]\s*karaoke', (1,), 2, 0.9),
    ("artist_quoted_karaoke", r'^([^-–—]+)\s*[-–—]\s*"([^"]+)"\s*\([^)]*karaoke[^)]*\)', (1,), 2, 0.85),
    ("bracket_artist_song", r"^\[([^\]]+)\]\s*([^-–—]+)[-–—](.+?)\s*\[[^\]]*karaoke[^\]]*\]", (2,), 3, 0.8),
]
IN_CONTEXT: list[Rule] = [
    ("context_dash", r"^([^-–—]+)\s*[-–—]\s*([^(\[]+)", (1,), 2, 0.65),
    ("context_quoted", r'^"([^"]+)"\s*[-–—]\s*"([^"]+)"', (1,), 2, 0.7),
    ("context_by", r"^([^(]+?)\s*\([^)]*by\s+([^)]+)\)", (2,), 1, 0.6),
]
CONTEXT = ["karaoke", "karafun", "karaoké", "karaokê", "караоке", "sing along", "backing track", "instrumental", "covers", "tribute", "piano version"]

#: The rules of the plain parse, tried on the title without its beginning marks. Fixed values.
PLAIN: list[Rule] = [
    ("plain_quoted", r'^"([^"]+)"\s*-\s*"([^"]+)"\s*\([^)]*karaoke[^)]*\)', (1,), 2, 0.95),
    ("plain_karaoke_quoted", r'^karaoke\s+"([^"]+)"\s*-\s*"([^"]+)"', (2,), 1, 0.95),
    ("plain_karaoke_dashes", r"^karaoke\s*-\s*([^-]+?)\s*-\s*(.+)$", (2,), 1, 0.95),
    ("plain_quoted_style", r'^"([^"]+)"\s*\([^)]*style\s+of\s+"([^"]+)"[^)]*\)', (2,), 1, 0.9),
    ("plain_channel_quoted_style", r'^[^-]+-\s*"([^"]+)"\s*\([^)]*style\s+of\s+"([^"]+)"[^)]*\)', (2,), 1, 0.9),
    ("plain_three_quoted", r'^"([^"]+)"\s*-\s*"([^"]+)"\s*-\s*"[^"]*karaoke[^"]*"', (1,), 2, 0.9),
    ("plain_quoted_run", r'^"([^"]+)"-"([^"]+)"\s*(?:"[^"]*")*\s*\([^)]*karaoke[^)]*\)', (1,), 2, 0.85),
    ("plain_film_quoted", r'^"[^"]+"\s*-\s*"([^"]+)"\s*"?\(?"?([^")]+)"?\)?"\s*\([^)]*karaoke[^)]*\)', (2,), 1, 0.85),
    ("plain_quoted_between", r'^"[^"]*karaoke[^"]*"\s*"([^"]+)"\s*"[^"]*karaoke[^"]*"', (), 1, 0.7),
    ("plain_brackets", r"^\[[^\]]*karaoke[^\]]*\]\s*([^-]+)-([^\[\]]+)\s*\[[^\]]*karaoke[^\]]*\]", (1,), 2, 0.9),
    ("plain_artist_song", r"^([^-]+?)\s*-\s*([^(]+?)\s*\([^)]*karaoke[^)]*\)", (1,), 2, 0.85),
    ("plain_style", r"^([^(]+?)\s*\([^)]*style\s+of\s+([^)]+?)\)(?:[^(]*\([^)]*karaoke[^)]*\))?", (2,), 1, 0.8),
    ("plain_channel_style", r"^[^-]+-\s*([^(]+?)\s*\([^)]*style\s+of\s+([^)]+?)\)", (2,), 1, 0.8),
    ("plain_by", r"^([^(]+?)\s+by\s+([^(]+?)\s*\([^)]*karaoke[^)]*\)", (2,), 1, 0.8),
    ("plain_artist_song_bracket", r"^([^-\[]+?)\s*-\s*([^\[]+?)\s*\[[^\]]*karaoke[^\]]*\]", (1,), 2, 0.8),
    ("plain_dash_only", r"^([^-–—(\[]+?)\s*[-–—]\s*([^(\[]+?)$", (1,), 2, 0.8),
    ("plain_song_artist", rf"^([^-–—]+?){DASH}([^(\[]+)(?:\s*[(\[][^)\]]*karaoke[^)\]]*[)\]])?", (2,), 1, 0.7),
    ("plain_song_only", r"^([^(]+?)\s*\([^)]*karaoke[^)]*\)", (), 1, 0.6),
]
#: What goes from the beginning of a title before the plain parse, in this order. Fixed values.
PLAIN_BEGINNINGS = [r"^\[[^\]]*\]\s*", r"^【[^】]*】\s*", r"^.*?karaoke[^:]*:\s*", r"^.*?presents\s*:?\s*"]
#: Where the description names an artist; its weight. Fixed values.
PLAIN_DESCRIPTION, PLAIN_DESCRIPTION_WEIGHT, PLAIN_OWN_WEIGHT = r"(?:by|artist|performed by):?\s*([^\n]+)", 0.5, 0.6

#: What a title must hold, in lower case, for a rule to be worth trying; a cheap test before the pattern.
NEEDED: dict[str, list[str]] = {
    "german_numbered": ["de"], "last_first": [",", "karaoke"], "song_karaoke_artist": ["(karaoke)"], "song_slash_artist": ["/", "karaoke"], "no_separator": ["(karaoke)"], "song_artist_pipe_karaoke": ["|", "karaoke"], "song_parens_artist_pipe": ["|", "("],
    "artist_song_pipe": ["|"], "dots": ["•", "karaoke"], "karaoke_song_artist_star": ["karaoke", "*"], "karaoke_song_artist": ["karaoke"], "quoted_artist_song": ['"', "karaoke"], "karaoke_quoted": ['"', "karaoke"], "quoted_style_of": ['"', "style"],
    "channel_quoted_style_of": ['"', "style"], "channel_quoted_artist_song": ['"', "karaoke"], "quoted_run": ['"-"', "karaoke"], "quoted_three": ['"', "karaoke"], "bracket_karaoke": ["[", "karaoke"], "bracket_end": ["[", "karaoke"],
    "song_artist_karaoke_end": ["karaoke", "("], "song_artist_karaoke_word": ["karaoke"], "artist_song_karaoke": ["karaoke", "("], "style_of": ["style", "("], "song_by_artist": ["by", "karaoke"], "hyphenated_song": ["-", "("], "song_only": ["karaoke", "("],
}

# Rules of known channels. A line that begins with @ names the channels' handles and ids; the lines
# below are the rules in the order in which they are tried: artist's group, song's group, weight, pattern. A
# channel that is named twice has the later rules.
_LIBRARY = r"""
@zzangkaraoke UCzv4mCu3YS_9WjAWSt9Xg9Q
1 2 0.95 \[짱가라오케/노래방\]\s*([^-]+(?:\([^)]*\))?)\s*-\s*(.+?)\s*\((?:Melody|MR/Instrumental)\)
1 2 0.90 ^([^-]+(?:\([^)]*\))?)\s*-\s*(.+?)\s*\((?:Melody|MR/Instrumental)\)\s*\(Karaoke Version\)
1 2 0.85 \[짱가라오케/노래방\]\s*(.+?)\s*-\s*(.+?)\s*\((?:Melody|MR/Instrumental)\)
1 2 0.80 ^([^-–—]+(?:\([^)]*\))?)\s*[-–—]\s*(.+?)\s*\((?:Melody|MR|Instrumental|Karaoke)
1 2 0.75 ^([^-–—]+(?:\([^)]*\))?)\s*[-–—]\s*(.+?)$
1 2 0.70 ^([^-–—]+(?:\([^)]*\))?)\s*[-–—]\s*(.+?)(?:\s*\[.*\])?$
@singkingkaraoke UCwTRjvjVge51X-ILJ4i22ew
1 2 0.95 ^(.+?)\s*-\s*(.+?)\s*\(Karaoke Version\)
1 2 0.90 ^(.+?)\s*-\s*(.+?)\s*\((?:Karaoke Version )?With Lyrics\)
1 2 0.90 ^(.+?)\s*-\s*(.+?)\s*\((?:No Vocals|Instrumental|Acoustic)\)
1 2 0.75 ^(.+?)\s*-\s*(.+?)$
@MusisiKaraoke UCJw1qyMF4m3ZIBWdhogkcsw
2 1 0.98 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke Songs With Lyrics - Original Key\)
2 1 0.95 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke Instrumental\)
2 1 0.85 ^(.+?)\s*-\s*([^()]+?)(?:\s*\(.*\))?$
@AtomicKaraoke UCutZyApGOjqhOS-pp7yAj4Q
2 1 0.98 ^(.+?)\s*-\s*([^()]+?)\s*\(HD Karaoke\)
2 1 0.95 ^(.+?)\s*-\s*([^|]+?)\s*\|\s*Karaoke
2 1 0.85 ^(.+?)\s*-\s*([^()|]+?)(?:\s*[|(].*)?$
@BandaisuanKaraoke001 UCuyBQQ2CISV0ptQRHBHzGuA
2 1 0.95 ^Karaoke\s*-\s*(.+?)\s*-\s*([^-]+?)(?:\s*\[.*\])?$
2 1 0.90 ^Karaoke\s*-\s*(.+?)\s*-\s*([^-]+?)\s*(?:\[|\().*$
2 1 0.70 ^(.+?)\s*-\s*([^-]+?)$
@karafun UCbqcG1rdt9LMwOJN4PyGTKg
2 1 0.95 ^(.+?)\s*-\s*([^|]+?)\s*\|\s*Karaoke Version\s*\|\s*KaraFun
2 1 0.85 ^(.+?)\s*-\s*([^|]+?)\s*\|\s*Karaoke
2 1 0.75 ^(.+?)\s*-\s*([^|]+?)(?:\s*\|.*)?$
@singkaraoke9783 UC1AgLpY5t66HaI3ejzLoyOg
2 1 0.95 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke\)
2 1 0.90 ^(.+?)\s*-\s*([^()]+?)\s+Karaoke$
2 1 0.75 ^(.+?)\s*-\s*([^()]+?)$
@karaokeytv0618 UCNbFgUCJj2Ls6LVzBbL8fqA
2 1 0.95 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke Version\)
2 1 0.85 ^.+?\s*-\s*(.+?)\s*-\s*([^()]+?)\s*\(Karaoke Version\)
2 1 0.85 ^(.+?)\s*-\s*([^()#]+?)(?:\s*#\d+)?\s*\(Karaoke
2 1 0.75 ^(.+?)\s*-\s*([^()#]+?)(?:\s*[#(].*)?$
@mibalmzkaraoke UCRoAoGqqLuOIWztkcxUiYoA
2 1 0.90 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke\)
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke\)
2 1 0.95 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke Instrumental(?:\s+(?:No Vocal|With Lyrics))?\)
2 1 0.70 ^(.+?)\s*-\s*([^()]+?)$
@thepropervolume UCw0WVzCSi9-X0RMxaj3gTpg
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\|\s*Instrumental Karaoke Version
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\|\s*Karaoke Version
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\((?:Instrumental )?(?:Backing Track|Play Along)\)
1 2 0.75 ^([^-|]+?)\s*-\s*([^|(]+?)(?:\s*[|(].*)?$
@sing2piano UCIk6z4gxI5ADYK7HmNiJvNg
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Piano Karaoke\)
2 1 0.90 ^(.+?)\s*(?:\(.*?\))?\s*\[Originally Performed by ([^\]]+?)\]\s*\[Piano Karaoke Version\]
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)(?:\s*\(.*)?$
@LugnKaraoke UCS4Q7GGXKdZW9uZ6YySe34Q
1 2 0.95 ^([^•]+?)\s*•\s*(.+?)\s*•\s*Karaoke
1 2 0.90 ^([^•]+?)\s*•\s*(.+?)\s*•\s*Karaoke\s*\(.*\)
1 2 0.80 ^([^•]+?)\s*•\s*(.+?)(?:\s*•.*)?$
@karafunde UCzEav_eOAmp23-s_cqBDpbA
2 1 0.95 ^(.+?)\s*-\s*([^()]+?)\s*\(Karaoke\)
- 1 0.80 ^(.+?)\s*\(Karaoke\)$
2 1 0.85 ^(.+?)\s*-\s*([^()]+?)\s+Karaoke$
2 1 0.75 ^(.+?)\s*-\s*([^()]+?)$
@FrauKnoblauch UC-AdlzvbJi7LvBkja531tVQ
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke\)
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\(Instrumental\)
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)$
@avd-karaoke UCvh3Hf-Ub4ZecC09RD2igjQ
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke\)\s*\[AVD-\d+\]
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke Version With Lyrics\)\s*\[AVD-\d+\]
1 2 0.85 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke
@quantumkaraoke UCY_0l0AngUurGCwAqF4NkzA
- 1 0.90 ^(.+?)\s*\|\s*Quantum Karaoke\s*\|
- - 0.70 ^Quantum Karaoke\s*\|\s*a Sing-Along Special\s*\|
2 1 0.85 ^(.+?)\s+by\s+([^()]+?)\s*\(Karaoke\)
@partytymekaraokechannel6967 UCWLqO9ztz16a_Ko4YB9PnFQ
2 1 0.95 ^(.+?)\s*\(Made Popular By ([^)]+?)\)\s*\(Karaoke Version\)
2 1 0.95 ^(.+?)\s*\(Made Popular By ([^)]+?)\)\s*\[Karaoke Version\]
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke Version\)
2 1 0.90 ^(.+?)\s*\(Made Popular By ([^)]+?)\)\s*\(Party Tyme Karaoke
@StingrayKaraoke UCYi9TC1HC_U2kaRAK6I4FSQ
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Karaoke with Lyrics\)
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\(Stingray Karaoke
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)$
@TheoMusicChannel UCWyWC9jEp_0ecel6Usj7j8Q
2 1 0.95 ^(.+?)\s*\|\s*(.+?)$
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*-\s*Lyrics$
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*-\s*Lyrics and Chords$
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\((?:Instrumental/Karaoke/Cover|Acoustic Instrumental)\)
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)(?:\s*-.*)?$
@FakeyOke UCvtLVf1qXFe_hmxlaB4Gh8Q
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\[Karaoke\]
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\(FakeyOke Karaoke\)
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)$
@songjam UCLYRNIeTQNmx1E9jVAFxSlA
1 2 0.95 ^([^-]+?)\s*-\s*(.+?)\s*\(Official Karaoke Instrumental\)\s*\|\s*SongJam
1 2 0.90 ^([^-]+?)\s*-\s*(.+?)\s*\(Backing Track\)
1 2 0.75 ^([^-]+?)\s*-\s*(.+?)(?:\s*[|(].*)?$
@edkara UCRrNOLvQ1LztDKbXtxvDAEQ
2 1 0.95 ^Karaoke♬\s*(.+?)\s*-\s*([^【]+?)\s*【With Guide Melody】\s*Instrumental
2 1 0.95 ^Karaoke♬\s*(.+?)\s*-\s*([^【]+?)\s*【No Guide Melody】\s*Instrumental
2 1 0.90 ^Karaoke\s*(.+?)\s*-\s*([^【]+?)\s*【.*Guide Melody】
2 1 0.75 ^(?:Karaoke♬?\s*)?(.+?)\s*-\s*([^【]+?)(?:\s*【.*)?$
@singkaraoke @singkaraoke9783 UC1AgLpY5t66HaI3ejzLoyOg
1 2 0.95 ^(.+?)\s*-\s*(.+?)\s*\(Karaoke\)
1 2 0.90 ^(.+?)\s*-\s*(.+?)\s+Karaoke
1 2 0.80 ^(.+?)\s*-\s*(.+?)$
"""


def _library() -> tuple[dict[str, list[Rule]], dict[str, str]]:
    """Rules by the first handle of a set, and the set of every handle and id."""
    sets: dict[str, list[Rule]] = {}
    of: dict[str, str] = {}
    name = ""
    for line in _LIBRARY.strip().splitlines():
        if line.startswith("@"):
            handles = line.split()
            name = handles[0][1:]
            sets[name] = []
            of |= dict.fromkeys(handles, name)
        else:
            artist, song, weight, pattern = line.split(" ", 3)
            sets[name].append((f"{name}_{len(sets[name])}", pattern, () if artist == "-" else (int(artist),), 0 if song == "-" else int(song), float(weight)))
    return sets, of


LIBRARY, LIBRARY_OF = _library()
