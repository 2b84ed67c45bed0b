"""They must equal those of the data's producers for right results, and stand here as they are there."""

# Query keys that say where a visitor came from.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "igshid", "si", "feature", "ref", "ref_src"]

# Words that no post is told apart by.
POST_STOP = [
    "the", "and", "for", "with", "that", "this", "from", "your", "you", "are", "was", "were", "has", "have", "had",
    "will", "would", "could", "should", "about", "into", "over", "under", "after", "before", "more", "most", "some",
    "video", "viral", "clip", "watch", "link", "post", "reel", "reels", "tweet", "thread", "news", "today", "new",
    "official", "original", "youtube", "tiktok", "instagram", "twitter", "reddit", "bluesky", "http", "https", "www",
    "ago", "day", "days", "hour", "hours", "minute", "minutes", "week", "weeks", "month", "months", "year", "years",
    "views", "view", "posts", "rank", "popular", "trending", "trend",
    "submitted", "comments", "comment", "shorts", "short", "com", "youtu",
]

# Words that no trend title is told apart by. Accents are stripped from tokens first, so some never match.
TITLE_STOP = ["the", "and", "for", "with", "from", "today", "season", "jr", "fc", "f.c", "maç", "kadrosu", "sayılı", "kanun", "genel", "müdürlüğü", "burs", "本人確認"]

# What a post's text is cleaned of, in this order, and what stands there then.
POST_URL = r"https?://[^\s<>()\]\[{}\"']+"
POST_REDACTIONS = [(POST_URL, " "), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[redacted-email]"), (r"(?<!\d)(?:\+?\d[\d\s().-]{7,}\d)(?!\d)", "[redacted-phone]"), (r"(?<![\w.])@[A-Za-z0-9_.-]{1,64}", "[mention]")]
POST_LENGTH = 500
POST_TOKEN = r"[a-z0-9][a-z0-9_-]{2,}"
TAG = r"<[^>]+>"

# Hosts whose links are kept.
LINK_HOSTS = ["tiktok.com", "www.tiktok.com", "vm.tiktok.com", "instagram.com", "www.instagram.com", "x.com", "www.x.com", "twitter.com", "www.twitter.com", "youtube.com", "www.youtube.com", "youtu.be", "reddit.com", "www.reddit.com", "old.reddit.com"]
LINK_TAIL = ".,;:!?)]}"

CRYPTO_TERMS = r"\b(memecoin|meme coin|pumpfun|pump\.fun|solana|cryptocurrency|bitcoin|crypto|token launch|launchpad)\b"

# Ladders' thresholds.
PROBE_USD = 50.0

# What a post's text or links hold that belongs to a bucket.
SOCIAL_BUCKETS = {
    "origin_tiktok": ["tiktok.com"], "origin_instagram": ["instagram.com"], "origin_x": ["x.com/", "twitter.com/"],
    "viral": ["went viral", "goes viral", "gone viral", "viral video", "viral clip", "breaks the internet"], "meme": [" meme", "meme ", "memes", "memeable"], "remix": ["remix", "remixed", "remixes"],
    "reaction": ["reaction video", "reaction image", "reaction meme"], "template": ["template", "green screen"], "parody": ["parody", "spoof"],
    "derivative": ["sticker", "fan art", "fanart", "fan account", "edit of", "edits of", "duet", "stitch"],
}
