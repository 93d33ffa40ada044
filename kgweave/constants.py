"""Values that belong to the semantics. Fixed values."""

LEVEL_RANK = {"1A": 1, "1B": 2, "2A": 3, "2B": 4, "3": 5, "4": 6}
UNKNOWN_RANK = 99
HIGH_EVIDENCE = ("1A", "1B", "2A", "2B")
CRITICAL_LEVELS = ("1A", "1B")
EDGE_VERB = {
    "affects_response_to": "affects response to",
    "linked_to_risk": "is linked to risk of",
    "has_variant": "has variant cluster",
    "associated_with": "is associated with",
    "can_trigger": "can trigger",
    "belongs_to_class": "belongs to drug class",
}
# three lists: of the application, of the evaluation (the default), and of its follow-up runs
APP_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "to", "for", "in", "on", "at", "by", "with", "from", "and", "or",
    "but", "if", "then", "than", "so", "as", "it", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why",
    "how", "does", "do", "did", "can", "could", "should", "would", "will", "have", "has", "had", "i", "you", "we", "they", "he", "she", "me", "us",
    "them", "him", "her", "between", "about", "into", "through", "during", "before", "after", "above", "below", "tell", "explain", "show", "list",
    "give", "find", "say", "see", "look", "describe", "any", "some", "all", "most", "more", "less", "very",
)
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "to", "for", "in", "on", "at", "by", "with", "from", "and", "or",
    "but", "if", "then", "than", "so", "as", "it", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why",
    "how", "does", "do", "did", "can", "could", "should", "would", "will", "have", "has", "had", "i", "you", "we", "they", "he", "she", "me", "us",
    "them", "him", "her", "between", "about", "into", "through", "during", "before", "after", "above", "below", "tell", "explain", "show", "list",
    "give", "find", "say", "see", "look", "describe", "any", "some", "all", "most", "more", "less", "very", "patient", "class", "gene", "drug",
    "phenotype", "variant", "carry", "carries", "carrying", "pharmacogenomic", "association", "associations", "reference", "references", "cite",
    "citation", "clinical", "evidence", "guideline", "guidelines", "level", "interaction", "interactions",
)
FOLLOW_UP_STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "of", "to", "for", "in", "on", "at", "by", "with", "from", "and", "or", "but", "if", "then",
    "than", "so", "as", "it", "this", "that", "these", "those", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "does", "do",
    "did", "can", "could", "should", "would", "will", "have", "has", "had", "between", "about", "into", "through", "pharmacogenomic", "association",
    "associations", "reference", "references", "cite", "citation", "clinical", "evidence", "guideline", "guidelines", "level", "interaction",
    "interactions", "carry", "carries", "carrying", "patient", "class", "gene", "drug", "phenotype", "variant",
)
DRUG_CLASSES = {
    "Volatile Anesthetics": ("sevoflurane", "isoflurane", "desflurane", "halothane", "enflurane", "methoxyflurane"),
    "Depolarizing Neuromuscular Blockers": ("succinylcholine",),
    "Thiopurines": ("azathioprine", "mercaptopurine", "thioguanine"),
    "Fluoropyrimidines": ("fluorouracil", "capecitabine", "tegafur"),
    "Vitamin K Antagonists": ("warfarin", "acenocoumarol", "phenprocoumon"),
    "Opioids": ("codeine", "tramadol", "oxycodone", "morphine", "fentanyl"),
    "SSRIs": ("fluoxetine", "sertraline", "paroxetine", "citalopram", "escitalopram", "fluvoxamine"),
    "Statins": ("simvastatin", "atorvastatin", "rosuvastatin", "pravastatin", "fluvastatin", "lovastatin"),
}
SEED_CLASSES = ("Volatile Anesthetics", "Depolarizing Neuromuscular Blockers")
#: Names outside the vocabulary, for questions that should be refused.
OOD_NAMES = (
    "vitamin C", "melatonin", "glucosamine", "echinacea", "valerian root", "St John's wort", "ginkgo biloba", "milk thistle", "saw palmetto",
    "coenzyme Q10", "creatine", "alpha-lipoic acid", "lutein", "psyllium", "lactobacillus", "berberine", "ashwagandha", "rhodiola", "lysine",
    "DHEA", "selenium yeast", "spirulina", "chlorella", "bromelain",
)
#: Questions of each stratum, arms, and the context of an arm without retrieval.
STRATA = {"S1": 20, "S2": 25, "S3": 40, "S4": 25, "S5": 25, "S6": 25, "S7": 15, "S8": 12}
ARMS = ("A0", "A1", "A2", "A3")
NO_CONTEXT = "(No retrieved context provided. Answer from your own knowledge if confident; otherwise say so.)"
SEED_TYPES = ("linked_to_risk", "affects_response_to", "can_trigger", "belongs_to_class", "associated_with")
MOST_RELATION_CHUNKS, MOST_NEGATIVES = 20_000, 5_000
MOST_HOPS, SEED_HOPS, SEED_NODES = 4, 3, 120
SEARCH_CUT, SEARCH_HITS, MOST_CITED, FALLBACK_CHARS = 0.35, 12, 12, 2_000
REFUSAL_CUES = (
    "not in pharmgkb", "not in the graph", "not in this graph", "no pharmacogenomic guideline", "no guideline", "no information",
    "no entries", "no results", "no associations", "no data", "cannot find", "could not find", "no specific guidance", "does not contain",
    "does not have", "is not present", "i don't have", "i do not have", "no retrieved context", "there is no", "there are no", "outside",
    "i'm unable", "no specific pharmacogenomic", "do not appear",
)
NEGATIVE_CUES = (
    "no clinically meaningful", "not clinically meaningful", "no clinically significant", "no significant", "no, ", "no.\n",
    "no association", "not associated", "no documented", "no curated evidence", "ambiguous", "not listed as associated",
)
LINK_CUT, MULTI_WORD_BONUS, HITS_PER_TERM, MOST_ENTITIES = 0.18, 0.05, 3, 6
TOP_K, TOP_FINAL, RRF_K = 20, 8, 60
MOST_PMIDS, MOST_CHUNK_PMIDS = 25, 10
BM25_K1, BM25_B = 1.5, 0.75
CHARS_PER_TOKEN = 3.7
