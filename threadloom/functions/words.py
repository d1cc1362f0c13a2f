"""Word lists and prompt texts."""

from __future__ import annotations

import functools
import glob
import os
import zipfile

import pyspark

# The stop words the forum pipeline adds to the language list.
CUSTOM_STOP_WORDS = [
    "with", "my", "your", "she", "this", "was", "her", "have", "as", "he",
    "him", "but", "not", "so", "are", "at", "be", "has", "do", "got",
    "how", "on", "or", "would", "will", "what", "they", "if", "get", "can",
    "we", "me", "his", "there", "them", "just", "am", "by", "that", "from",
    "it", "is", "in", "you", "also", "very", "had", "a", "an", "for",
]

# ISO code of a language and the name of its list in Spark MLlib.
STOP_WORD_LANGUAGES = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}

# Prompt texts sent to the labelling model.
PROMPT_LABEL = """
I have topic that contains the following documents: \n[DOCUMENTS]
The topic is described by the following keywords: [KEYWORDS]

Based on the above information, can you give a short label of the topic?
"""
PROMPT_CHAT_START = """
I will send you documents. After I send you the documents, I will ask you to write a short description capturing the commonalities across all documents.
"""
PROMPT_CHAT_DOCUMENT = """
This is one of the documents:
[DOCUMENTS]
"""
PROMPT_CHAT_END = """
I need you to write "The topic is:" then print a short description of the documents in markdown format.
"""
PROMPT_SUMMARY_START = (
    "I am sending you a lot of scraped text from a forum online. Once I am done sending chunks, "
    "you will summarize everything I sent. After each chunk tell me you receive it and track how many I sent you."
)
PROMPT_SUMMARY_CHUNK = "I am sending you a chunk. Here is a chunk: "
PROMPT_SUMMARY_END = "I am done sending chunks. Please summarize everything I sent."

# ASCII punctuation, in code point order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@functools.lru_cache(maxsize=None)
def language_stop_words(name: str) -> tuple[str, ...]:
    """The stop-word list that ships with Spark MLlib.

    Read from the MLlib jar where that is at hand, so that plans and SQL text
    can be built before a session exists; otherwise asked from the session.
    """
    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    for home in homes:
        for path in sorted(glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))):
            with zipfile.ZipFile(path) as jar:
                data = jar.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt")
            return tuple(w for w in data.decode("utf-8").split("\n") if w)
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(name))


def default_stop_words() -> list[str]:
    """Language list of English joined with the pipeline's own words."""
    return sorted(set(language_stop_words("english")) | set(CUSTOM_STOP_WORDS))
