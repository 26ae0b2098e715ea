"""Word lists and weights that decide results. All fixed values, in their natural order."""

KARAOKE = ["karaoke", "backing track", "instrumental", "sing along", "minus one", "playback", "accompaniment", "with lyrics", "guide vocals", "piano version", "acoustic version"]
NOT_KARAOKE = ["reaction", "review", "tutorial", "lesson", "how to", "analysis", "behind the scenes", "interview", "documentary", "live performance", "concert", "official video"]
KARAOKE_CHANNEL = ["karaoke", "backing track", "instrumental", "sing along", "minus one", "playback", "accompaniment", "lyrics"]

#: Weights of words that speak for or against a recording's quality.
QUALITY = {
    "4k": 1.0, "2160p": 1.0, "hd": 0.8, "1080p": 0.8, "720p": 0.6, "high quality": 0.7, "studio": 0.8, "professional": 0.7, "remastered": 0.6,
    "flac": 1.0, "lossless": 1.0, "320kbps": 0.9, "high bitrate": 0.8, "studio quality": 0.8, "cd quality": 0.7,
    "with lyrics": 0.9, "lyrics on screen": 0.9, "guide vocals": 0.7, "backing vocals": 0.6, "instrumental": 0.8, "minus one": 0.8, "key change": 0.5, "pitch control": 0.5,
    "low quality": -0.5, "poor audio": -0.6, "out of sync": -0.8, "broken": -1.0, "corrupted": -1.0, "incomplete": -0.7,
}
VERIFIED_CHANNELS = {"sing king": 0.9, "karaoke mugen": 0.8, "zoom karaoke": 0.7, "karafun": 0.8}
PROFESSIONAL = ["official", "records", "music", "entertainment", "studio", "productions", "media"]
AMATEUR = ["home", "bedroom", "cover", "personal", "my"]

#: Weights of words in the relevance of a search hit, and of a channel's own video.
HIT_WORDS = {"hd": 0.2, "4k": 0.3, "high quality": 0.2, "studio": 0.2, "professional": 0.2, "with lyrics": 0.3, "guide vocals": 0.2}
CHANNEL_WORDS = {"hd": 0.1, "4k": 0.2, "high quality": 0.1, "with lyrics": 0.2, "guide vocals": 0.1}

#: Least and most seconds of a channel's videos, by the first word found in its name.
DURATIONS = {"sing king": (10, 2400), "sing karaoke": (10, 2400), "karafun": (30, 1800), "zzang": (15, 1500), "let's sing": (15, 1500), "karaoke": (15, 1800), "backing": (30, 2400), "instrumental": (30, 2400)}
DURATION_ELSE = (15, 1500)

FEATURES = {
    "has_guide_vocals": ["guide vocal", "guide melody", "demo vocal", "vocal guide"],
    "has_scrolling_lyrics": ["scrolling lyrics", "moving lyrics", "karaoke style"],
    "has_backing_vocals": ["backing vocals", "background vocals", "harmony"],
    "is_instrumental_only": ["instrumental only", "no vocals", "backing track only"],
    "is_piano_only": ["piano only", "piano version", "piano karaoke"],
    "is_acoustic": ["acoustic", "unplugged", "acoustic version"],
}

NO_ARTIST = ["karaoke", "instrumental", "backing track", "minus one", "mr", "inst", "version", "sing along", "cover", "remix", "quality", "audio", "video"]
#: What a name can't be as a whole, in three sets: technical terms, kinds of recording, general terms.
NO_NAME = [
    ["mp3", "mp4", "wav", "flac", "audio", "video", "hd", "4k", "1080p"],
    ["karaoke", "instrumental", "backing track", "minus one", "playback"],
    ["music", "song", "track", "number", "piece", "composition"],
]
NO_SONG = ["karaoke", "instrumental", "backing track", "minus one", "mr", "inst"]
NO_GUEST = [
    "rights holders", "rights holder", "copyright", "all rights reserved", "record label", "music group", "publishing", "records", "entertainment", "distribution", "ltd", "inc", "corp", "llc", "gmbh",
    "karaoke version", "instrumental", "melody", "backing track", "original artist", "various artists", "soundtrack", "compilation", "unknown artist", "remix", "edit", "version", "remaster",
]
HOLIDAY = [
    "silent night", "jingle bells", "let it snow", "silver bells", "deck the halls", "rudolph", "mary had a baby", "joy to the world", "o come all ye faithful", "away in a manger", "what child is this",
    "auld lang syne", "feliz navidad", "mary's boy child", "little drummer boy", "chestnuts roasting", "i'll be home for christmas", "christmas", "holiday", "xmas", "winter", "santa", "sleigh", "carol",
    "noel", "nativity", "advent", "bethlehem", "mistletoe", "holly", "ivy", "wreath", "hark the herald", "o holy night",
]
