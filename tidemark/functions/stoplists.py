"""Stop-word lists. All entries are fixed values; tokens are compared with them exactly.

Entries with an apostrophe, a hyphen or a space never equal a cleaned token. They are kept,
because cleaning removes such characters before the comparison and the words then survive.
"""

from __future__ import annotations

# The general English list (179 words).
GENERAL = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their
theirs themselves what which who whom this that that'll these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# The domain lists, one per profile.
TWITTER = """
rt retweet dm fomo idk lol lmao rofl brb omg wtf btw tbh imo imho irl smh afaik ftw ftl dm tl bf
bff hashtag follow followers followback followfriday ff mention mentions like likes reply replies
shit damn fuck fucking bitch bastard crap asshole dick piss bollocks bloody bugger arse cock cunt
yo hey sup wanna gonna gotta kinda lemme ain't gotta lemme cuz cause tho thx pls plz tweet tweets
twitter timeline trending viral trends http https www com co twittercom tco
""".split()

AMAZON = """
product item goods purchase order package packaging shipment delivery shipping quality durability
defect defective broken faulty damage warranty return refund feature features specifications size
weight color design material performance functionality battery screen resolution sound speed
customer service support helpful satisfied recommend recommendation disappointed expectation
review reviews rating ratings feedback comment comments star stars price cost value expensive
cheap affordable discount deal sale offer use used usage install installation compatible
performance easy difficult manual fast slow delay tracking carrier electronics appliance clothing
shoes book beauty toy game furniture tool
""".split()

SPOTIFY = """
app application spotify music song songs playlist playlists album albums artist artists stream
streaming download downloads downloading downloaded shuffle repeat playlist offline online library
interface ui ux layout search searched searching recommendation recommendations suggest suggests
suggested buffer buffering crash crashed crashing bug bugs glitch glitches premium subscription
subscribe subscribed account login logged logging share shared sharing follow following followers
""".split()

FILM_LONG = """
movie movies film films cinema screen plot story script screenplay scene scenes character
characters role roles director directing direction actor actors actress actresses cast performance
performances dialogue dialogues production producer studio editing editor set setting effect
effects specialeffects cgi sound soundtrack music score cinematography lighting camera angle
review reviews rating ratings critique critic critics award awards nomination nominations festival
screening comedy drama thriller horror romance action adventure sci-fi sciencefiction fantasy
documentary animation biography crime classic blockbuster release released premiere premiered
boxoffice gross budget trailer teaser
""".split()

FILM_SHORT = """
action, comedy, drama, horror, thriller, romance, sci-fi, documentary, animation, director, actor,
actress, producer, writer, filmmaker, cast, crew, screenplay, dialogue, plot, character, scene,
climax, soundtrack, special effects, cinematography, premiere, release, screening, sequel,
prequel, trilogy, adaptation, editing, score, sound design, visual effects, production, lighting,
viewer, audience, fans, fandom, blockbuster, box office, flop, theater, cinema, home viewing,
matinee, midnight screening
"""
FILM_SHORT = [entry.strip() for entry in FILM_SHORT.split(",")]

FILM_SMALL = """
movie movies film films character characters scene scenes director directing actor actors actress
actresses performance performances studio production edit editing set setting effect effects sound
soundtrack music review reviews rating ratings critique criticized criticize award awards comedy
drama thriller horror romance classic blockbuster release released premiere premiered
""".split()

PROFILES: dict[str, list[str]] = {
    "twitter": TWITTER,
    "amazon": AMAZON,
    "spotify": SPOTIFY,
    "film_long": FILM_LONG,
    "film_short": FILM_SHORT,
    "film_small": FILM_SMALL,
}

# The profile of each side in each train/test pair; pairs and sides not listed
# (single-domain runs, leave-one-out runs) use the general list alone.
PAIR_PROFILES: dict[tuple[str, str], tuple[str | None, str | None]] = {
    ("amazon", "twitter"): ("amazon", "twitter"),
    ("imdb", "amazon"): ("film_long", "amazon"),
    ("imdb", "twitter"): ("film_short", "twitter"),
    ("rotten_tomatoes", "amazon"): ("film_long", "amazon"),
    ("rotten_tomatoes", "imdb"): ("film_small", None),
    ("rotten_tomatoes", "spotify"): ("film_long", "spotify"),
    ("rotten_tomatoes", "twitter"): ("film_long", "twitter"),
    ("spotify", "amazon"): ("spotify", "amazon"),
    ("spotify", "imdb"): ("spotify", "film_short"),
    ("spotify", "twitter"): ("spotify", "twitter"),
}
