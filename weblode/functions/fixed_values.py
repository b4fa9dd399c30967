"""Fixed values.

Word lists, patterns, thresholds and confidences that must equal the behaviour being
reproduced, so that results agree.  Nothing here is logic.  Patterns are Java regular
expressions; case-insensitive ones carry ``(?i)``.
"""

# --- fixed values: characters the web platform counts as white space -----------------
WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# --- fixed values: markup that is never rendered --------------------------------------
COMMENT = r"(?s)<!--.*?-->"
NON_RENDERED = r"(?is)<(script|style|template|svg|math)\b[^>]*>.*?</\1\s*>"

# --- fixed values: entities, in the order they are decoded -----------------------------
ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
]

# --- fixed values: field and parameter names -------------------------------------------
SEARCH_FIELDS = [
    "q", "query", "search", "s", "keyword", "keywords", "term", "searchterm",
    "find_desc", "k", "_nkw", "search_term_string", "text",
]
PAGE_FIELD = r"(?i)^(?:page|p|page_num|pagenum|page_number|pagenumber)$"
SKIPPED_FIELD_TYPES = ["hidden", "submit", "button", "image", "reset", "file"]
TRACKING_PARAM = r"(?i)^(utm_|pd_rd_|pf_rd_|_$|fbclid$|gclid$|ref_?$|mc_|igshid$|s_kwcid$)"

# --- fixed values: detail-page path segments -------------------------------------------
PRODUCT_SEGMENTS = ["dp", "product", "products", "itm", "sku"]
SLUG_ID_SEGMENT = r"(?i)^[a-z0-9][a-z0-9-]+_\d+$"
# segment -> (tool name, parameter name)
ENTITY_SEGMENTS = {
    "package": ("get_package_page", "package"),
    "author": ("get_author_page", "author"),
    "gems": ("get_gem_page", "gem"),
}
LINK_WITHOUT_TEXT_PATH = r"(?i)/(dp|products?|items?|p)/"
LISTING_HREF = r"(?i)/(dp|products?|item|items|itm|sku|p)/"
PRODUCT_PAGE_URL = r"(?i)/dp/|/products?/"
COMMERCE_URL = r"(?i)/dp/|/products?/|/itm/"

# --- fixed values: identifiers in paths --------------------------------------------------
ID_SEGMENTS = [
    r"^\d+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^[0-9a-f]{12,}$",
    r"(?i)^[a-z0-9][a-z0-9-]*[-_]\d+$",
]
CALL_ID_SEGMENT = (
    r"(?i)^(\d+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{12,})$"
)
PLURAL_ENDINGS = [("(?i)ies$", "y"), ("(?i)ses$", "s"), ("(?i)s$", "")]
GENERIC_SEGMENT = (
    r"(?i)^(v\d+|\d+|api|apis|rest|restli|gql|graphql|service|services|ajax|json|data|public"
    r"|internal|web|www|mobile|app|backend|gateway)$"
)
CALL_PATH_HINT = r"(?i)[/{](?:id|asin|sku|product|item|search|query|results?|flight|hotel|car)"

# --- fixed values: calls that are noise ---------------------------------------------------
NOISY_HOST = (
    r"(?i)(google-analytics|googlesyndication|googletagmanager|googleadservices|doubleclick|2mdn"
    r"|newrelic|nr-data|segment|sentry|hotjar|amplitude|optimizely|facebook|connect\.facebook|bing"
    r"|adsrvr|demdex|datadog|scorecardresearch|moatads|doubleverify|adsafeprotected|criteo|taboola"
    r"|outbrain|quantserve|chartbeat|parsely|fwmrm|litix|brightline|onetrust|cookielaw|branch\.io"
    r"|mixpanel|fullstory|mouseflow|clarity\.ms|snowplow|tealium|krxd|rubiconproject|pubmatic|openx"
    r"|casalemedia|smartadserver|adnxs|3lift|bidswitch|media\.max\.com|discomax|imrworldwide|nielsen"
    r"|comscore)"
)
NOISY_PATH = (
    r"(?i)(?:^|/)(collect|collector|analytics|tracking|telemetry|metrics|events?|pagead|conversion"
    r"|viewthroughconversion|newrelic|nrjs|jserrors|experimentchokepoint|ccm|rmkt|tallyman"
    r"|loginwebevent|funnel|beacon|pixel|impression|gtm|gtag|stats|logging|ping|rum|vitals|consent"
    r"|cmp|gdpr|playbackinfo|heartbeat)(?:/|$)|/g/collect\b|/sid\.json\b"
)
STATIC_ASSET = (
    r"(?i)\.(?:js|mjs|css|map|png|jpe?g|gif|svg|ico|woff2?|ttf|otf|eot|webmanifest|webp|avif|bmp|mp4"
    r"|m4s|m4a|ts|mp3|wav|webm|mov|avi|mkv|flv|aac|ogg|oga|ogv|flac|m3u8|mpd|vtt|srt|pdf|zip|gz)$"
)
NOISY_CONTENT_TYPE = (
    r"(?i)(?:^|[^a-z])(video|audio|image|font)/|beacon|analytics|telemetry|tracking|octet-stream"
    r"|event-stream"
)

# --- fixed values: secrets -------------------------------------------------------------------
SECRET_HEADERS = [
    "authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "proxy-authorization",
]
SECRET_FIELD_GLOBS = [
    "*token*", "*secret*", "*password*", "*session*", "pwd", "*passcode*", "*otp*", "*cvv*",
    "*cvc*", "*ccv*", "cardNumber", "card_number", "*ssn*", "securityCode", "security_code",
]
SECRET_QUERY_NAMES = ["api_key", "apikey", "access_token", "token", "sig", "signature", "key"]
REDACTED = "__redacted__"
SENSITIVE_INPUT = (
    r"""(?i)type\s*=\s*["']?password|autocomplete\s*=\s*["']?(?:current-password|new-password"""
    r"""|one-time-code)|(?:name|id)\s*=\s*["']?[^"'>\s]*(?:passw(?:or)?d|pwd|otp|one[-_]?time|cvv"""
    r"""|cvc|ccv|card[-_]?number|ssn|secret|security[-_]?code)"""
)
INPUT_VALUE_ATTR = r"""(?i)\svalue\s*=\s*(?:"[^"]*"|'[^']*'|[^\s">]+)"""

# --- fixed values: request-body inputs ----------------------------------------------------------
BODY_INPUT_KEY = (
    r"(?i)^(q|query|search|search_?query|search_?term|search_?text|keywords?|term|text|input|prompt"
    r"|message|continuation|cursor|after|before|offset|page|page_?number|page_?size|start|limit|count"
    r"|first|num|video_?id|browse_?id|channel_?id|playlist_?id|slug|username|handle|user_?id"
    r"|product_?id|sku|asin|lat|latitude|lng|lon|longitude|location|near|sort|sort_?by|order|filter"
    r"|category|tag)$"
)
BODY_FIXED_KEY = (
    r"(?i)^(context|client|client_?version|client_?name|client_?form_?factor|request_?metadata"
    r"|internal_?experiment_?flags|consistency_?token_?jars|visitor_?data|user|csn|click_?tracking"
    r"|tracking_?params|session_?index|capabilities|device_?params|gl|hl|locale|timezone|tz)$"
    r"|^(x_?goog|sec_?)"
)
PRIMARY_INPUT_KEY = (
    r"(?i)^(q|query|search|search_?query|search_?term|search_?text|keywords?|term|text|input|prompt"
    r"|message)$"
)

# --- fixed values: forms --------------------------------------------------------------------------
CHALLENGE_FORM = r"(?i)captcha|nocaptcha|recaptcha|challenge|human.?verification|verify.?human"
LOW_VALUE_FORM_ACTION = (
    r"(?i)feedback|custom[_-]?scopes?|newsletter|subscribe|signup|sign[_-]?up|survey"
    r"|report[_-]?(?:abuse|content)?"
)

# --- fixed values: page kinds -----------------------------------------------------------------------
TRAVEL_TEXT = (
    r"\b(?:flights?|airport|airfare|depart(?:ure|ing)?|roundtrip|round trip|one[- ]way|travell?ers?"
    r"|adults?|hotels?|stays?|car rental|cars? hire)\b"
)
TRAVEL_HOST = r"(^|\.)(?:skyscanner|booking|expedia|kayak|airbnb|hotels|tripadvisor)\."
TRAVEL_TYPE = r"(?i)flight|trip|travel|hotel|lodgingbusiness|airline"
COMMERCE_TEXT = r"add to cart|add to basket|buy now|availability|in stock|out of stock"
COMMERCE_TEXT_EXEMPT_URL = r"(?i)news\.ycombinator\.com"
COMMERCE_TYPE = r"(?i)product|offer"
CART_TEXT = r"cart|basket|checkout"
STATE_DETAIL = r"product|sku|asin|offer|price"
STATE_LISTING = r"results|searchterm|search_term|string|items|edges|products"

# --- fixed values: page actions, name -> (pattern, confidence), in order of testing ------------------
ACTION_CONTROLS = {
    "go_to_next_page": (r"(?i)\b(next|show more|load more|more results)\b", 0.62),
    "go_to_previous_page": (r"(?i)\b(previous|prev|back results)\b", 0.58),
    "add_to_cart": (r"(?i)\b(add to cart|add to basket)\b", 0.7),
    "open_cart": (r"(?i)\b(cart|basket|view cart)\b", 0.61),
}
ACTION_DELTA_ORDER = ["add_to_cart", "open_cart", "go_to_next_page", "go_to_previous_page"]
TRAVEL_FIELDS = {
    "origin": r"\b(from|origin|leaving|depart(?:ing|ure)? from)\b",
    "destination": r"\b(to|destination|arriv(?:e|al)|going to)\b",
    "depart_date": r"\b(depart|outbound|leaving date|depart date)\b",
    "return_date": r"\b(return|inbound|return date)\b",
    "cabin": r"\b(cabin|class)\b",
    "passengers": r"\b(passengers?|travell?ers?|guests?)\b",
}

# --- fixed values: cleaning of mined endpoints ----------------------------------------------------------
AUTH_PATH = (
    r"(?i)(?:^|/)(?:log[-_]?in|sign[-_]?in|sign[-_]?up|signin|signup|register|logout|sso|oauth2?"
    r"|password[-_]?reset)(?:/|$)"
)
PROBE_PATH = (
    r"(?i)(?:^|/)(?:isalive|alive|health(?:z|check)?|ping|heartbeat|liveness|readiness)(?:/|$)"
)
INFRA_HOST = (
    r"(?i)(?:^|\.)(?:telemetry|rum|beacon|sentry|datadog|newrelic|nr-data|amplitude|mixpanel)\."
)
PROTECTED_NAMES = ["fetch_page_content", "extract_page_metadata"]
MUTATION_VERBS = (
    r"(?i)\b(create|creat|update|delete|deletes|remove|removes|destroy|add|adds|insert|submit|save"
    r"|saves|buy|purchase|order|checkout|pay|payment|send|sends|post|posts|upload|cancel|book|reserve"
    r"|register|signup|subscribe|unsubscribe|edit|modify|patch|put|set|enable|disable|approve|reject"
    r"|like|follow|unfollow|vote|comment|rename|move|merge|deploy|publish|revoke|grant|invite)\b"
)

# --- fixed values: walls and gates (four separate lists on purpose) --------------------------------------
RENDERED_WALL = (
    r"(?i)captcha|are you (?:a )?human|verify you are human|unusual traffic|just a moment"
    r"|checking your browser|enable javascript and cookies|access (?:to this page has been )?denied"
    r"|attention required|sorry[!,. ]+something went wrong|cf-chl|px-captcha|akamai"
    r"|please verify you are|bot or not|perimeterx|pardon our interruption"
    r"|enable cookies to continue"
)
# words of which every match of the two wall patterns holds at least one
WALL_WORDS = [
    "captcha", "human", "unusual traffic", "just a moment", "checking your browser",
    "enable javascript and cookies", "denied", "attention required", "something went wrong",
    "cf-chl", "akamai", "please verify you are", "bot or not", "perimeterx",
    "pardon our interruption", "enable cookies to continue",
]
STATIC_WALL = (
    r"(?i)are you a human|verify you are human|unusual traffic|captcha|just a moment"
    r"|checking your browser|enable javascript and cookies|access (?:to this page has been )?denied"
    r"|attention required"
)
NAVIGATION_WALL = [
    "captcha", "enter the characters you see", "automated access",
    "api-services-support@amazon", "unusual traffic", "/cdn-cgi/challenge-platform",
    "just a moment...", "verify you are a human", "human verification", "client challenge",
    "checking your browser", "enable javascript and cookies", "are you a robot", "px-captcha",
    "access to this page has been denied",
]
PROBE_WALL = [
    "captcha", "enter the characters you see", "automated access", "unusual traffic",
    "/cdn-cgi/challenge", "just a moment...", "verify you are a human", "are you a robot",
    "access to this page has been denied", "px-captcha",
]
PASSWORD_FIELD = r"""(?i)<input\b[^>]*\btype\s*=\s*["']?password\b"""
LOGIN_TITLE = (
    r"(?i)\b(sign[ -]?in|log[ -]?in|log[ -]?on|authenticate|create (?:an )?account|your account)\b"
)
LOGIN_PAGE_URL = (
    r"(?i)/(login|log-in|signin|sign-in|sign_in|auth(?:enticate)?|authwall|session|account|sso"
    r"|uas/login)\b"
)
AUTH_WALL_TEXT = (
    r"(?i)sign\s?in to (?:continue|view|see|access|read|watch)"
    r"|log\s?in to (?:continue|view|see|access|read|watch)|join (?:linkedin|to view|now to)"
    r"|please (?:sign|log)\s?in to|sign\s?in to your account to|members? log\s?in"
    r"|you must (?:be )?(?:signed|logged)\s?in|create an account or sign in"
    r"|to continue, (?:sign|log)\s?in"
)
# words of which every match of the sign-in pattern holds at least one
AUTH_WALL_WORDS = [
    "sign", "log", "join linkedin", "join to view", "join now to", "create an account or sign in",
]
APP_MOUNT = (
    r"""(?i)<(?:div|main|section)[^>]+id=["'](?:root|app|__next|app-root|__nuxt|svelte"""
    r"""|application)["']"""
)
NEEDS_SCRIPT = (
    r"(?i)\b(?:enable javascript|you need to enable javascript|please enable javascript"
    r"|requires javascript)\b"
)
LOGIN_LANDING_URL = (
    r"(?i)(?:^|[/.?#&=])(?:log[-_]?in|sign[-_]?in|signin|sign[-_]?up|signup|authenticate|authorize"
    r"|oauth2?|sso|account[s]?/(?:login|signin|sign-in))(?:[/.?#&=]|$)"
)
LOGIN_TEXT = [
    "sign in to continue", "please sign in", "please log in", "log in to continue",
    "you must be logged in", "you need to sign in", "session expired",
    "your session has expired", "login required",
]

# --- fixed values: crawl frontier ------------------------------------------------------------------------
FRONTIER_HREF = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""
FRONTIER_SKIP_SCHEME = r"(?i)^(?:mailto:|tel:|javascript:|data:|blob:)"
FRONTIER_ASSET = (
    r"(?i)\.(?:css|js|mjs|cjs|png|jpe?g|gif|svg|webp|avif|ico|bmp|pdf|zip|gz|tar|mp4|webm|mp3|wav"
    r"|woff2?|ttf|otf|eot|json|xml|rss|txt|csv)(?:$|\?)"
)
FRONTIER_AUTH = (
    r"(?i)/(?:logout|sign[-_]?out|log[-_]?off|login|sign[-_]?in|signin|auth(?:enticate)?"
    r"|account/logout|session/(?:end|destroy))\b"
)

# --- fixed values: sensitive pages --------------------------------------------------------------------------
SENSITIVE_PATH = (
    r"(?i)(?:^|/|\b)(checkout|payment|billing|shipping|order(?:s|[-_]?confirmation)?|cart|account"
    r"|profile|settings|login|log[-_]?in|signin|sign[-_]?in|signup|sign[-_]?up|register|password"
    r"|reset|auth|oauth|sso|session|wallet|address|invoice)(?:/|\b|$)"
)
SENSITIVE_FIELD = (
    r"(?i)(?:password|passcode|otp|2fa|mfa|token|secret|session|auth|cookie|csrf|card|cc-|credit|cvv"
    r"|cvc|security[-_ ]?code|expiry|expiration|routing|iban|bank|ssn|sin|tax|address|phone|email)"
)
SENSITIVE_TEXT = (
    r"(?i)(?:checkout|payment|billing|shipping address|card number|credit card|debit card|cvv|cvc"
    r"|security code|expiration date|password|one[-_ ]?time code|verification code|social security"
    r"|order confirmation|invoice)"
)
# words of which every match of the text pattern holds at least one
SENSITIVE_TEXT_WORDS = [
    "checkout", "payment", "billing", "shipping address", "card number", "credit card",
    "debit card", "cvv", "cvc", "code", "expiration date", "password", "social security",
    "order confirmation", "invoice",
]
LONG_DIGITS = r"\b(?:\d[ -]?){12,19}\b"

# --- fixed values: records ------------------------------------------------------------------------------------
PRICE_TEXT = r"(?:\$|£|€|CAD\s?)[\d,.]+"
RATING_TEXT = r"(?i)\b\d(?:\.\d)?\s*(?:out of 5|/5|stars?)\b"
SKU_PATH = r"(?i)/(?:dp|product|products|item|itm|sku|p)/([^/?#]+)"

# --- fixed values: address ranges that are not public, base and prefix length -----------------------------------
PRIVATE_IPV4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4),
    ("240.0.0.0", 4),
]
PRIVATE_IPV6_PREFIXES = ["fc", "fd", "fe80:", "ff"]

# --- fixed values: API descriptions, in probing order ---------------------------------------------------------------
SPEC_LOCATIONS = [
    "/openapi.json", "/swagger.json", "/swagger/v1/swagger.json", "/v3/api-docs", "/api-docs",
    "/api-docs.json", "/api/openapi.json", "/api/swagger.json", "/v1/openapi.json",
    "/openapi/v1.json", "/.well-known/openapi.json", "/docs/openapi.json",
]
GRAPHQL_LOCATIONS = ["/graphql", "/api/graphql", "/v1/graphql", "/query", "/gql"]
SPEC_METHODS = ["get", "post", "put", "patch", "delete"]
JSON_TYPES = ["string", "integer", "number", "boolean", "array", "object"]

# --- fixed values: verification ----------------------------------------------------------------------------------------
PLACEHOLDER_TARGET = r"(?i)\{|\}|B000000000|example\.com|\bplaceholder\b"
VERIFIED_FLOOR = 0.8
GENERALIZED_FLOOR = 0.9
DAMPED_CEILING = 0.3

# --- fixed values: closed enumerations -----------------------------------------------------------------------------------
LEGAL_MODES = ["safe", "full_scrape", "session"]
CAPTURE_SOURCES = ["scraper", "extension"]
FORM_PURPOSES = ["search", "auth", "form", "filter"]
ACTION_KINDS = ["link", "button", "input", "select", "menuitem"]
PARAM_PLACES = ["path", "query", "header", "body"]
STEP_ACTIONS = ["navigate", "fill", "click", "selectOption", "pressKey", "waitFor", "extract"]
SERVER_STATUSES = ["active", "degraded", "broken", "regenerating"]
SERVER_TIERS = ["curated", "auto_gen"]
FAILURE_CLASSES = ["selector_miss", "http_4xx", "http_5xx", "schema_mismatch", "timeout"]
TOOL_NAME = r"^[a-z][a-z0-9_]*$"
ROBOTS_POLICY_WORDS = {
    "respect": ["respect", "safe", "obey", "follow", "true", "1"],
    "full": ["full", "ignore", "off", "full_scrape", "false", "0"],
}
