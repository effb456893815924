"""Word lists, patterns, weights and limits that rules are defined by."""

# The rules' outcomes depend on exactly these words, patterns and numbers.

STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]

EMOTIONS = {
    "excitement": (["amazing", "incredible", "fantastic", "wow", "exciting", "thrilling", "awesome", "brilliant"], r"\b(oh my god|holy\s+shit|no way|unbelievable|mind.blowing)\b", {"amazing": 1.5, "incredible": 2.0, "fantastic": 1.8}),
    "curiosity": (["interesting", "fascinating", "intriguing", "wonder", "mysterious", "puzzling", "curious"], r"\b(what if|how does|why do|tell me more|I wonder)\b", {"fascinating": 1.8, "intriguing": 1.6}),
    "surprise": (["surprised", "shocked", "unexpected", "sudden", "reveal", "twist", "twist", "revelation"], r"\b(turns out|suddenly|out of nowhere|plot twist|didn't expect)\b", {"shocked": 2.0, "revelation": 1.9}),
    "inspiration": (["inspiring", "motivating", "uplifting", "hope", "dream", "achieve", "possible", "transform"], r"\b(you can do|never give up|believe in|make it happen|change your life)\b", {"transform": 2.0, "inspiring": 1.7}),
    "concern": (["worried", "concerned", "problem", "issue", "trouble", "difficult", "challenging", "struggle"], r"\b(be careful|watch out|I'm worried|that's concerning|major problem)\b", {"struggle": 1.8, "challenging": 1.5}),
    "relief": (["relief", "better", "solved", "fixed", "calm", "peaceful", "safe", "secure"], r"\b(thank god|finally|at last|much better|problem solved)\b", {"relief": 1.8, "peaceful": 1.6}),
    "humor": (["funny", "hilarious", "amusing", "joke", "laugh", "comedy", "witty", "clever"], r"\b(ha ha|lol|that's funny|you're kidding|good one)\b", {"hilarious": 2.0, "witty": 1.6}),
    "authority": (["research", "studies", "evidence", "data", "proven", "scientific", "expert", "professional"], r"\b(research shows|studies indicate|data proves|according to experts)\b", {"proven": 1.8, "scientific": 1.7}),
}
POSITIVE_EMOTIONS, NEGATIVE_EMOTIONS = ["excitement", "curiosity", "inspiration", "relief", "humor"], ["concern", "surprise"]

POLARITY = (["happy", "amazing", "great", "wonderful", "excited", "love"], ["sad", "angry", "frustrated", "disappointed", "hate", "terrible"])
SENTIMENT = (["great", "amazing", "excellent", "wonderful", "fantastic", "love", "best", "perfect"], ["bad", "terrible", "awful", "hate", "worst", "problem", "issue", "difficult"])
FEELINGS = {"happy": ["happy", "joy", "excited", "amazing", "wonderful"], "sad": ["sad", "cry", "miss", "sorry", "unfortunately"], "surprised": ["wow", "amazing", "unbelievable", "shocked"], "angry": ["angry", "mad", "frustrated", "annoyed"]}
TENSION = ["but", "however", "suddenly", "unexpected", "shock"]
REFERENCES = ["this", "that", "it", "they", "earlier", "mentioned"]

BEAT_PHRASES = {
    "hook": ["let me tell you", "you won't believe", "imagine if", "what if"],
    "climax": ["the moment", "suddenly", "everything changed", "peaked"],
    "resolution": ["in the end", "finally", "the lesson", "learned"],
    "call_to_action": ["subscribe", "follow", "share", "comment", "try this"],
}
BEAT_PATTERNS = {
    "hook": ["let me tell you", "you won't believe", "this changed everything", "the moment when"],
    "context": ["background", "started when", "originally", "at the time"],
    "climax": ["suddenly", "then everything changed", "the turning point", "peaked when"],
    "resolution": ["in the end", "finally", "the lesson", "what I learned"],
}
#: beat -> (from position, to position, words, confidence)
STORY_BANDS = {
    "hook": (None, 0.2, ["today", "let me", "imagine", "what if", "question"], 0.7),
    "setup": (0.2, 0.4, ["background", "context", "first", "originally", "before"], 0.6),
    "development": (0.4, 0.7, ["important", "key", "main", "significant", "because"], 0.6),
    "climax": (0.7, 0.85, ["discovered", "found", "realized", "breakthrough", "crucial"], 0.8),
    "resolution": (0.85, None, ["conclusion", "summary", "takeaway", "remember", "final"], 0.7),
}
BEAT_TITLES = {"hook": "Opening", "setup": "Context", "inciting_incident": "Problem", "development": "Main Point", "climax": "Key Insight", "resolution": "Takeaway"}
BEAT_ORDER = ["hook", "setup", "inciting_incident", "development", "climax", "resolution"]
STRATEGY_ORDER = ["hook", "development", "climax", "resolution"]

SCENE_BOOSTS = [
    (["today", "imagine", "what if", "question", "let me"], 0.15),
    (["discovered", "realized", "breakthrough", "important", "crucial"], 0.20),
    (["data", "shows", "percent", "improvement", "results"], 0.15),
    (["story", "felt", "changed", "personal", "experience"], 0.10),
]
SUPERLATIVES = ["amazing", "incredible", "unbelievable"]
AUDIO_KEYWORDS = ["amazing", "incredible", "wow", "fantastic", "beautiful", "important", "key", "main", "first", "best", "great", "question", "answer", "explain", "show", "demonstrate"]
CONTEXTS = {
    "money": ["money", "cash", "dollar", "pay", "cost", "price"],
    "food": ["eat", "food", "hungry", "delicious", "cook", "meal"],
    "travel": ["travel", "trip", "visit", "fly", "vacation", "journey"],
    "tech": ["computer", "app", "software", "ai", "tech", "digital"],
    "music": ["music", "song", "sing", "dance", "melody", "beat"],
    "sports": ["game", "play", "win", "team", "score", "match"],
    "education": ["learn", "study", "teach", "school", "knowledge"],
    "nature": ["nature", "tree", "flower", "mountain", "ocean", "forest"],
}
EMPHASIS = ["important", "remember", "key", "critical", "amazing"]
VIRAL_TAGS = ["fyp", "viral", "trending", "foryou", "explore", "reels"]
PATTERN_SCORES = {"peak": 0.9, "building": 0.8, "volatile": 0.7, "drop": 0.6, "plateau": 0.4, "low": 0.2}
LEGACY_KEYWORDS = ["important", "key", "crucial", "amazing", "incredible", "breakthrough", "discovery", "research", "study", "significant", "remarkable", "fascinating", "surprising", "shocking", "revolutionary", "innovative", "groundbreaking", "success", "achievement", "victory", "champion", "excellent", "outstanding", "expert", "professor", "doctor", "scientist", "leader", "authority"]
SIGNIFICANT_WORDS = ["breakthrough", "discovery", "amazing", "incredible", "important", "crucial"]

TOPICS = {
    "health": r"\b(health|diet|exercise|nutrition|medical|doctor|therapy|wellness)\b",
    "business": r"\b(business|company|market|sales|revenue|profit|strategy|growth)\b",
    "science": r"\b(research|study|data|analysis|discovery|science|experiment|findings)\b",
    "technology": r"\b(technology|digital|software|ai|algorithm|innovation|platform)\b",
    "education": r"\b(learn|teach|education|knowledge|skill|training|development)\b",
    "personal": r"\b(life|personal|experience|story|journey|challenge|success)\b",
    "finance": r"\b(money|financial|investment|cost|price|budget|economic)\b",
    "relationships": r"\b(family|friend|relationship|love|marriage|partner|community)\b",
}
ROLES = {
    "expert": r"\b(research shows|studies indicate|data suggests|evidence points|scientifically)\b",
    "host": r"\b(welcome|today we|let me ask|that\'s interesting|tell us about)\b",
    "guest": r"\b(thank you for having me|great question|in my experience|what I\'ve found)\b",
    "interviewer": r"\b(how do you|what about|can you explain|would you say)\b",
    "storyteller": r"\b(once upon|happened to me|I remember when|let me tell you)\b",
    "educator": r"\b(the key is|important to understand|fundamental principle|basic concept)\b",
    "motivator": r"\b(you can do|believe in yourself|never give up|achieve your goals)\b",
}
HOOKS = [
    r"\b(what if|imagine if|have you ever|did you know|what would happen)\b",
    r"\b(why do|how can|what makes|where does|when will)\b",
    r"\b(the question is|here's what|let me ask you)\b",
    r"\b(this will change|everything you know|never seen before|incredible discovery)\b",
    r"\b(most people don't|secret to|truth about|hidden)\b",
    r"\b(breakthrough|revolutionary|game.changer|unprecedented)\b",
    r"\b(it all started|began when|first time|years ago)\b",
    r"\b(little did I know|never imagined|suddenly|one day)\b",
    r"\b(let me tell you|here's what happened|story begins)\b",
    r"\b(right now|happening today|urgent|critical moment)\b",
    r"\b(time is running|can't wait|immediate|this instant)\b",
    r"\b(before it's too late|limited time|act now)\b",
]
CLIMAXES = [
    r"\b(turns out|discovered that|realized|found out|the truth is)\b",
    r"\b(breakthrough moment|aha moment|suddenly understood|it hit me)\b",
    r"\b(the answer was|key insight|revelation|epiphany)\b",
    r"\b(biggest challenge|moment of truth|critical point|breaking point)\b",
    r"\b(everything changed|pivotal moment|turning point|climax)\b",
    r"\b(crisis|emergency|disaster|catastrophe|collapse)\b",
    r"\b(finally achieved|reached the goal|accomplished|succeeded)\b",
    r"\b(moment of victory|breakthrough|triumph|pinnacle)\b",
    r"\b(peak performance|highest point|ultimate|maximum)\b",
    r"\b(overwhelming|incredible feeling|never felt|most intense)\b",
    r"\b(tears of joy|heart racing|speechless|blown away)\b",
    r"\b(life.changing|transformative|profound impact)\b",
]

MASK = "***MASKED***"
#: (pattern, group that is masked; 0: the whole match), in the order in which they apply.
SECRETS = [
    (r"\bsk-[a-zA-Z0-9]{20,}\b", 0),
    (r"\bsk-ant-[a-zA-Z0-9]{20,}\b", 0),
    (r"\bAKIA[0-9A-Z]{16}\b", 0),
    (r"""(?i)(api[_\-]?key|apikey|api_secret)\s*[:=]\s*["']?([^"'\s,}]+)""", 2),
    (r"""(?i)(password|passwd|pwd)\s*[:=]\s*["']?([^"'\s,}]+)""", 2),
    (r"""(?i)(token|access_token|refresh_token|auth_token)\s*[:=]\s*["']?([^"'\s,}]+)""", 2),
    (r"""(?i)(secret|client_secret)\s*[:=]\s*["']?([^"'\s,}]+)""", 2),
    (r"(?i)Bearer\s+([a-zA-Z0-9\-_.=/+]+)", 1),
    (r"(?i)(postgresql|postgres|mysql|mongodb|redis)://([^@]+)@", 2),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", 0),
    (r"\b\d{3}-\d{2}-\d{4}\b", 0),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
]

ARCS = {"man_in_hole": [0, -0.5, -0.8, -0.5, 0.3, 0.6], "cinderella": [0, 0.3, -0.6, -0.8, 0.5, 1.0], "tragedy": [0, 0.3, 0.5, 0.2, -0.5, -0.8], "comedy": [-0.3, -0.5, 0, 0.3, 0.6, 0.8]}
