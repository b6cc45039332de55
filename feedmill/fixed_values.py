"""Formats, patterns, limits and labels that results depend on.

Everything here is plain data.  Operators import it; nothing else in the package repeats it.
"""

# --- Fixed values: labels -----------------------------------------------------------------
SOURCE_TYPES = ("youtube", "openai", "anthropic", "blog")
PROCESSING_STATUSES = ("pending", "extracting", "summarizing", "embedding", "completed", "failed")
EMAIL_FREQUENCIES = ("daily", "weekly", "custom")
DELIVERY_STATUSES = ("pending", "sent", "failed", "bounced")
STAGES = ("extraction", "summarization", "embedding")
QUEUES = ("extraction", "summarization", "embedding", "email")
UNKNOWN_QUEUE = "unknown"

# --- Fixed values: limits -----------------------------------------------------------------
MAX_RETRIES = 3
DEFAULT_HOURS_BACK = 24
RECENT_LIMIT = 100
RUN_HISTORY_LIMIT = 10
MAX_ARTICLES_PER_SOURCE = 5
EXTRACTED_MIN_CHARS = 100        # strictly more than this counts as extracted
SUMMARY_MIN_CHARS = 50           # fewer than this is rejected
EMBEDDING_MIN_CHARS = 10         # fewer than this is rejected
QUALITY_MIN_CHARS = 100          # fewer than this is rejected
PAGE_TEXT_MIN_CHARS = 100        # strictly more than this accepts a content element
SUMMARY_PROMPT_CHARS = 25000
EMBEDDING_CHARS = 5000
SHORT_PROMPT_CHARS = 2000
PREVIEW_CHARS = 300
EMBEDDING_DIM = 384
SEARCH_MIN_QUERY_CHARS = 2
SEARCH_MIN_LIMIT = 1
SEARCH_MAX_LIMIT = 50
SCORER_ATTEMPTS = 3
SCORER_WAIT_SECONDS = (2.0, 10.0)

# --- Fixed values: defaults ---------------------------------------------------------------
NO_TITLE = "No Title"
NO_PROMPT_TITLE = "N/A"
DEFAULT_READER = "Reader"
ELLIPSIS = "..."
NO_LINK = "#"
LINK_BASE_URL = "http://localhost:8000"
PAGE_METHOD = "beautifulsoup"    # label of the plain-text extraction
SNIPPET_METHOD = "rss_parse"     # label of a parsed feed snippet
RAW_METHOD = "raw"               # label of a snippet kept as it came

# --- Fixed values: error texts ------------------------------------------------------------
EXTRACTION_FAILED = "Content extraction failed"
INSUFFICIENT_CONTENT = "Insufficient content"
INSUFFICIENT_TEXT = "Insufficient text"
SUMMARIZATION_FAILED = "Summarization failed"
EMBEDDING_FAILED = "Embedding generation failed"

# --- Fixed values: URL shapes and patterns ------------------------------------------------
CHANNEL_FEED_PREFIX = "https://www.youtube.com/feeds/videos.xml?channel_id="
CHANNEL_PAGE_MARKS = ("youtube.com/@", "youtube.com/c/", "youtube.com/user/")
FEED_URL_SUFFIXES = (".xml", ".rss", "/feed", "/rss")
VIDEO_ID_PATTERNS = (
    r"(?:v=|\/)([0-9A-Za-z_-]{11}).*",
    r"(?:embed\/)([0-9A-Za-z_-]{11})",
    r"(?:watch\?v=)([0-9A-Za-z_-]{11})",
)
CHANNEL_ID_IN_PAGE_PATTERNS = (
    r'"channelId":"(UC[\w-]+)"',
    r'"externalId":"(UC[\w-]+)"',
)
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
TRANSCRIPT_LANGUAGES = ("en", "en-US", "en-GB")

# --- Fixed values: page markup ------------------------------------------------------------
PAGE_NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "iframe")
PLAIN_TEXT_NOISE_TAGS = ("script", "style")
SNIPPET_NOISE_TAGS = ("script", "style", "img", "video")
CONTENT_CLASS_WORDS = ("content", "post", "article", "entry")

# --- Fixed values: date formats -----------------------------------------------------------
LONG_DATE = "MMMM dd, yyyy"
SHORT_DATE = "MMM dd, yyyy"

# --- Fixed values: prompts ----------------------------------------------------------------
SUMMARY_SYSTEM_PROMPT = """You are an AI news summarizer specializing in technology and AI news.
Your task is to create concise, informative summaries of articles.

Guidelines:
1. Create a 2-3 sentence summary that captures the main points
2. Extract 3-5 key points as bullet points
3. Focus on technical details, innovations, and implications
4. Be objective and factual
5. Use clear, professional language

Return your response as JSON with this exact structure:
{
    "summary": "2-3 sentence summary here",
    "key_points": ["point 1", "point 2", "point 3"]
}"""
SUMMARY_PROMPT_HEAD = "Analyze and summarize the following article:"
SUMMARY_PROMPT_TAIL = "Provide a JSON response with the summary and key points."
SHORT_PROMPT_HEAD = "Now, summarize this article in 2-3 concise sentences:"
ARTICLE_PROMPT_HEAD = (
    "Summarize the following article in 2-3 concise sentences. "
    "Focus on the key points, what's new, and why it matters."
)
ARTICLE_PROMPT_LENGTH_NOTE = "  # Limit content length"
DIGEST_PROMPT_HEAD = """Create a daily digest email from the following articles. For each article, write a concise 2-3 sentence summary that captures the key points and why it matters.

Format the output as follows:
- Group articles by source
- For each article, provide: a brief summary and the original URL
- Use clear, engaging language
- Maintain a professional tone"""
DIGEST_PROMPT_TAIL = "Generate the digest:"
SNIPPET_FORMAT = "**%s**\n%s\n[Read more](%s)\n"

# --- Fixed values: bodies of mails --------------------------------------------------------
SUBSCRIBED_NOTE = "You're receiving this because you subscribed to "
ARTICLES_NOTE = " new articles from your news sources"
UNSUBSCRIBE_LABEL = "Unsubscribe"
PREFERENCES_LABEL = "Manage Preferences"
GENERATED_HTML_NOTE = "This digest was automatically generated by "
GENERATED_TEXT_NOTE = "Generated by "
