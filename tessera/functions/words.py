"""Word lists that results depend on."""

# Tokens that are no keywords.
STOPWORDS = (
    "the and or of in to a an is are was were for with that which what where when who whose how by on as at from this it its he she "
    "him her his hers you your i me my we our they them their had has have do does did so but not no yes one be"
).split()

# Keywords that say too little to link two memories.
GENERIC_EDGE_KEYWORDS = (
    "film american british directed drama comedy series book books novel music album football team home chunk chapter letter they "
    "their them she her hers he him his you your my mine our had has have but not one so known based people city"
).split()

# Keywords of which an overlap alone is of low information.
LOW_INFORMATION_EDGE_KEYWORDS = "analysis answer article case data document evidence example information method question report research result study system text".split()

# Keywords that no insight is named after (besides the names of retrieval methods).
INSIGHT_STOP_KEYWORDS = (
    "问题 答案 检索方法 答案状态 支持证据 证据 embedding_topk found "
    "found_in_retrieved_context retrieved context support evidence question answer method mode"
).split()

# Keywords that reconstruction ignores (besides the names of retrieval methods).
RECONSTRUCTION_STOP_KEYWORDS = (
    "问题 答案 检索方法 答案状态 支持证据 证据 evidence support claim embedding_topk found context question answer method "
    "able about after also another became been being between called came could during first from have into made many more most "
    "other over same some than that their then there these this through under used were when where which while with would"
).split()

# Terms of an answer that don't count.
ANSWER_STOPWORDS = "and or the a an of in to is are was were with from when after before but his her him she he it this that".split()

# Words that begin questions and are no entities.
QUESTION_WORDS = "what which why where when who how".split()
