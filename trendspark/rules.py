"""Fixed values that must equal the reference's for equal results.

Keyword lists, dictionaries and thresholds, stated plainly and in their
original order (first match wins where a list is ordered). Operators take
them as parameters; these are only the defaults.
"""

from __future__ import annotations

# --- fixed values: news-domain stop words (added to the base English list) ---
NEWS_DOMAIN_STOPS = [
    "said", "say", "says", "told", "tell", "tells", "reported",
    "according", "added", "noted", "called",
    "like", "just", "know", "new", "one", "two", "three", "first",
    "good", "big", "great", "old", "little", "right", "small",
    "time", "year", "years", "day", "days", "week", "month",
    "today", "ago", "now", "long",
    "make", "makes", "made", "way", "get", "gets", "got",
    "go", "goes", "going", "gone", "come", "coming",
    "take", "takes", "took", "see", "look", "looks", "looking",
    "think", "use", "uses", "used", "want", "wants", "need", "needs",
    "back", "even", "also",
    "people", "man", "woman", "men", "women", "person", "world",
    "photos", "video", "watch", "via", "amp", "huffpost",
    "huffington", "post",
    "dont", "doesnt", "didnt", "isnt", "wasnt", "arent",
    "im", "youre", "thats", "its", "hes", "shes", "theyre",
    "ive", "weve", "theyll", "wont", "cant", "couldnt",
    "10", "20", "2013", "2014", "2015", "2016", "2017",
    "2018", "2019", "100", "000",
    "us", "u", "really", "actually", "still", "already",
]

# --- fixed values: signal words that trigger the cohort fallback in prediction ---
HEALTHCARE_SIGNALS = ["affordable", "obamacare", "medicaid", "mandate",
                      "supreme", "repeal", "aca", "healthcare", "insurance"]
# substring pattern of the fallback cohort (matches inside words, e.g. law -> lawyer)
HEALTHCARE_COHORT_PATTERN = "health|court|affordable|law|insurance|mandate"
HEALTHCARE_COHORT_BEFORE_YEAR = 2020

# --- fixed values: ordered label rules (first rule with any keyword as substring wins) ---
SEMANTIC_RULES = [
    (["coronavirus pandemic", "coronavirus outbreak"], "COVID-19 Pandemic 2020"),
    (["covid19 vaccine", "vaccination", "vaccinated"], "COVID-19 Vaccination Campaign"),
    (["coronavirus", "covid19", "pandemic"], "COVID-19 Crisis"),
    (["ukraine", "ukrainian", "putin"], "Russia-Ukraine War 2022"),
    (["stormy daniels"], "Trump-Stormy Daniels Scandal"),
    (["mueller", "muellers"], "Mueller Investigation 2017-19"),
    (["impeachment", "colbert"], "Trump Impeachment Era"),
    (["border wall"], "US-Mexico Border Wall Debate"),
    (["roy moore"], "Alabama Senate Race 2017"),
    (["bernie sanders", "bernie", "sanders"], "2016 Democratic Primary"),
    (["hillary clinton", "hillary", "clinton"], "2016 Presidential Election"),
    (["joe biden", "biden administration"], "2020 Presidential Election"),
    (["trump administration", "donald trump", "donald trumps"], "Trump Presidency 2017-21"),
    (["fox news"], "Fox News & Conservative Media"),
    (["reform", "campaign", "political"], "US Political Campaigns"),
    (["beauty", "bride", "wedding"], "Wedding & Beauty"),
    (["halloween", "costume", "holiday", "christmas"], "Holidays & Entertainment"),
    (["childhood", "parenting", "baby", "marriage"], "Parenting & Family Life"),
    (["fashion", "dress", "style twitter", "magazine"], "Fashion & Style Trends"),
    (["fashion", "style"], "Fashion & Lifestyle"),
    (["healthy", "sleep", "wellness"], "Health & Wellness"),
]

# --- fixed values: ground-truth keywords -> valid years (ordered; first match wins) ---
GROUND_TRUTH_VERIFIED = [
    ("ukraine", [2014, 2021, 2022]),
    ("ukrainian", [2022]),
    ("putin", [2014, 2022]),
    ("russia", [2014, 2022]),
    ("coronavirus", [2020, 2021]),
    ("coronavirus pandemic", [2020]),
    ("coronavirus outbreak", [2020]),
    ("covid", [2020, 2021]),
    ("covid19", [2020, 2021]),
    ("pandemic", [2020]),
    ("vaccine", [2021]),
    ("vaccination", [2021]),
    ("vaccinated", [2021]),
    ("stormy daniels", [2018]),
    ("mueller", [2017, 2018]),
    ("impeachment", [2019, 2020]),
    ("colbert", [2019, 2020]),
    ("border wall", [2018, 2019]),
    ("border", [2018, 2019]),
    ("roy moore", [2017]),
    ("hillary clinton", [2015, 2016]),
    ("hillary", [2015, 2016]),
    ("sanders", [2015, 2016]),
    ("bernie", [2015, 2016]),
    ("trump administration", [2016, 2017, 2018]),
    ("donald trump", [2016, 2017, 2018, 2019]),
    ("joe biden", [2020]),
    ("biden administration", [2021]),
    ("obama", [2012, 2013, 2014]),
]

# --- fixed values: event names per ground-truth keyword (default: keyword in title case) ---
GROUND_TRUTH_EVENT_NAMES = {
    "ukraine": "Russia-Ukraine War",
    "ukrainian": "Russia-Ukraine War 2022",
    "coronavirus pandemic": "COVID-19 Pandemic 2020",
    "covid19": "COVID-19 Pandemic",
    "vaccine": "COVID-19 Vaccination Campaign",
    "stormy daniels": "Trump-Stormy Daniels Scandal",
    "mueller": "Mueller Investigation 2017-19",
    "impeachment": "Trump Impeachment",
    "border wall": "US Border Wall Crisis",
    "roy moore": "Alabama Senate Race 2017",
    "hillary clinton": "2016 Presidential Election",
    "hillary": "2016 Presidential Election",
    "sanders": "2016 Democratic Primary",
    "trump administration": "Trump Presidency",
    "joe biden": "2020 Presidential Election",
    "biden administration": "Biden Presidency",
    "obama": "Obama Administration",
}

# --- fixed values: event dictionary of the prediction service (ordered) ---
# (keyword, real_years, event_name, category, verified)
GROUND_TRUTH_EVENTS = [
    ("russia-ukraine", [2014, 2022], "Russia-Ukraine War", "geopolitical", True),
    ("ukraine war", [2022], "Russia-Ukraine War 2022", "geopolitical", True),
    ("covid-19 pandemic", [2020, 2021], "COVID-19 Pandemic", "health", True),
    ("covid-19 vaccination", [2021], "COVID-19 Vaccine Rollout", "health", True),
    ("trump impeachment", [2019, 2020], "Trump Impeachment Proceedings", "politics", True),
    ("mueller investigation", [2017, 2018, 2019], "Mueller Investigation", "politics", True),
    ("stormy daniels", [2018], "Trump-Stormy Daniels Scandal", "politics", True),
    ("2016 presidential election", [2015, 2016], "2016 US Presidential Election", "politics", True),
    ("2016 democratic primary", [2015, 2016], "2016 Democratic Primary (Sanders vs Clinton)", "politics", True),
    ("trump presidency", [2016, 2017, 2018, 2019, 2020], "Trump Presidency 2017-2021", "politics", True),
    ("parenting & family", [], "Lifestyle / Parenting Content", "lifestyle", False),
    ("wedding & beauty", [], "Lifestyle / Beauty Content", "lifestyle", False),
    ("fashion & style", [], "Fashion & Style Coverage", "lifestyle", False),
    ("holidays & entertainment", [], "Seasonal / Entertainment Content", "entertainment", False),
]

# --- fixed values: lifestyle words of the layered verdict ---
LIFESTYLE_KEYWORDS = ["fashion", "beauty", "wedding", "parenting", "holiday",
                      "entertainment", "style", "celebrity", "food", "travel"]

# --- fixed values: thresholds ---
LOW_CONFIDENCE_GATE = 0.15
OUTLIER_REASSIGN_THRESHOLD = 0.1
VERDICT_LEVELS = [(0.75, "VERIFIED_REAL"), (0.55, "LIKELY_REAL"), (0.40, "UNCERTAIN"),
                  (0.25, "LIKELY_NOISE")]
VERDICT_FLOOR = "VERIFIED_NOISE"

# --- fixed values: event category by verdict of the model, and the reasons given ---
MODEL_CATEGORIES = {"VERIFIED_REAL": "news_event", "LIKELY_REAL": "news_event", "UNCERTAIN": "unknown",
                    "LIKELY_NOISE": "general", "VERIFIED_NOISE": "lifestyle"}
MODEL_REASONS = {"VERIFIED_REAL": "GBM classifier: P(real)=%.2f (high confidence)",
                 "LIKELY_REAL": "GBM classifier: P(real)=%.2f (moderate confidence)",
                 "UNCERTAIN": "GBM classifier: P(real)=%.2f — borderline, flagged for review",
                 "LIKELY_NOISE": "GBM classifier: P(real)=%.2f — background topic",
                 "VERIFIED_NOISE": "GBM classifier: P(real)=%.2f — confirmed non-event"}
REASON_GATE = "Low topic confidence (%.1f%%) — text may not match any known topic in the corpus."
REASON_DICTIONARY = "Ground-truth: %s in [%s]"
REASON_DICTIONARY_NOISE = "Ground-truth: lifestyle/entertainment content"
REASON_EMERGING = "EMERGING signal + GDELT verified"
REASON_LIFESTYLE = "Lifestyle/entertainment topic — not a discrete news event."
REASON_NONE = "No model, dictionary or signal evidence for this topic."

# --- fixed values: the English stop words of Spark ML's StopWordsRemover (public, Apache Spark) ---
ENGLISH_STOPS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't",
    "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't",
    "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
]
