"""The word lists of the profile operators."""

BIAS = {
    "confirmation_bias": "confirms proves validates supports consistent expected affirms corroborates justifies vindicates agree proven verify",
    "availability_heuristic": "always never every constantly typically usually common frequent often mostly generally everywhere invariably",
    "sunk_cost": "already invested spent committed wasted poured continue persist stop quit lost sacrifice abandon",
    "optimism_bias": "definitely certainly surely guaranteed succeed bound win confident positive hopeful optimistic promising achieve",
    "negativity_bias": "terrible awful horrible disaster catastrophe failure worst hopeless ruined destroyed devastating dreadful appalling",
    "hindsight_bias": "obvious clearly predictable inevitable course knew expected foresaw apparent evident natural should hindsight",
    "overconfidence": "certain definite impossible absolutely doubt perfect flawless infallible undeniable unquestionable undoubtedly without necessarily",
    "in_group_bias": "we our ours them they those outsiders others foreign stranger enemy ally tribe",
    "anchoring": "first initial originally baseline starting reference begin start opening default standard foundation anchor",
    "framing_effect": "gain loss win lose save risk safe dangerous profit cost benefit downside upside",
}
VALUES = {
    "epistemic": "truth honest accuracy knowledge clarity understanding evidence certain verify transparency insight reason logic precise reliable",
    "moral": "justice fairness harm care integrity virtue compassion dignity respect rights ethics moral values conscience principle",
    "aesthetic": "beauty elegance meaning depth creativity craft coherence grace expression style artistry vision design nuance richness",
    "instrumental": "growth efficiency progress learn improve build achieve produce develop succeed advance master optimise innovate solve",
    "social": "trust loyalty cooperate community share belong relate connect support collaborate solidarity kinship reciprocity fellowship mutual",
}
MORAL = {
    "consequentialist": "result consequence outcome benefit harm cost effect impact welfare utility produce leads improves damages reduces increases total net greater best",
    "deontological": "must duty obligation right principle forbidden rule justice owed required prohibited ought mandate rights respect dignity never always binding categorical",
    "virtue": "honest brave just kind wise virtuous excellence character integrity noble courageous compassion generous humble patient prudent temperate loyal faithful grace",
}
ADVERSITY = {
    "loss": "lost grief gone death missing departed bereaved mourning absence ended",
    "failure": "failed collapsed crashed defeated bombed missed flopped tanked fell broke",
    "rejection": "rejected refused ignored dismissed excluded abandoned unwanted cold shut avoided",
    "threat": "danger attacked hostile threatening unsafe alarming menacing scary violent aggressive",
    "uncertainty": "uncertain confused unclear unsure ambiguous unknown vague unpredictable chaotic lost",
}
KIND = "okay allowed human normal forgive accept gentle kind patient understand imperfect natural learning growth enough"
HARSH = "stupid pathetic worthless useless weak failure terrible awful hopeless inadequate shameful disgusting horrible lazy idiot"
SUCCESS = "succeed achieved completed mastered solved accomplished worked improved passed managed correct effective capable confident ready"
FAILURE = "failed wrong error mistake struggle unable difficult broken ineffective poor lost missed inadequate weak confused"
ACTIONS = "improve reduce increase enable build create learn apply practice develop analyze optimize implement design test solve train strengthen generate construct establish"
PRESCRIPTIVE = "should must ought always expected appropriate acceptable required standard recommended"
PROHIBITIVE = "never forbidden inappropriate unacceptable prohibited avoid"
BELIEF_VERBS = "said thinks believes wants expects argues claims suggests reports needs hopes fears knows decided prefers stated noted agreed denied"
CAUSAL = "causes enables produces prevents reduces increases requires triggers inhibits leads results improves damages strengthens weakens"
#: word -> (valence, intensity)
EMOTIONS = {
    "happy": (0.8, 0.6), "sad": (-0.7, 0.6), "angry": (-0.8, 0.9), "excited": (0.9, 0.8), "fear": (-0.6, 0.8), "surprise": (0.3, 0.7),
    "love": (0.9, 0.7), "hate": (-0.9, 0.8), "anxious": (-0.5, 0.7), "calm": (0.3, 0.2), "joy": (0.9, 0.7), "grief": (-0.8, 0.9),
    "hope": (0.6, 0.5), "despair": (-0.9, 0.8), "proud": (0.7, 0.6), "ashamed": (-0.6, 0.7), "grateful": (0.8, 0.5), "jealous": (-0.5, 0.6),
    "content": (0.5, 0.3), "frustrated": (-0.6, 0.7), "crisis": (-0.5, 0.8), "success": (0.8, 0.6), "failure": (-0.7, 0.7),
    "growth": (0.6, 0.5), "decline": (-0.5, 0.5), "breakthrough": (0.8, 0.8),
}


def words(s: str) -> list[str]:
    return s.split()

# Words that tell the domain of a query, for the core paths and for the ensemble.
CORE_DOMAINS = {
    "finance": "stock market price trading investment rate earnings revenue profit economic financial crypto bitcoin",
    "tech": "software code programming algorithm computer api data model neural machine learning technology",
    "science": "research study experiment theory quantum physics biology chemistry scientific discovery",
    "weather": "weather temperature rain storm climate forecast wind humidity",
    "health": "health medical disease treatment patient clinical drug therapy diagnosis",
}
ENSEMBLE_DOMAINS = {
    "finance": CORE_DOMAINS["finance"] + " bank",
    "tech": CORE_DOMAINS["tech"] + " cloud server",
    "science": CORE_DOMAINS["science"] + " hypothesis",
    "weather": CORE_DOMAINS["weather"] + " snow",
    "health": CORE_DOMAINS["health"] + " vaccine",
}

# Suffixes that stemming takes off, in this order, each with the least letters left.
SUFFIXES = {4: "ational ization fulness iveness ousness", 3: "ating ation ments ering ities iness ment ness ence ance ting ling ring ings ally ious ical ing ies ion ity ful ous ive ble ant ent ist ed er ly al es ty s"}

# Words that tell the type of an entity, in the order they are tried, and words that name none.
ENTITY_TYPES = {
    "person": "mr mrs dr prof president ceo founder author researcher",
    "org": "inc corp ltd company university institute foundation group team",
    "location": "city country state region street river mountain island ocean",
    "event": "war election conference summit crisis pandemic revolution launch",
}
NO_ENTITY = "the this that with from have been will would could should about their there which other into more some also just very most such only then when what they them than each"
# Patterns of relations between two words.
RELATIONS = {
    "is_a": r"(?i)(\w+)\s+(?:is|was|are|were)\s+(?:a|an|the)\s+(\w+)",
    "works_at": r"(?i)(\w+)\s+(?:works?|worked)\s+(?:at|for|with)\s+(\w+)",
    "causes": r"(?i)(\w+)\s+(?:causes?|caused)\s+(\w+)",
    "affects": r"(?i)(\w+)\s+(?:affects?|affected)\s+(\w+)",
    "leads_to": r"(?i)(\w+)\s+(?:leads?\s+to|led\s+to)\s+(\w+)",
    "associated_with": r"(?i)(\w+)\s+(?:and|with|or)\s+(\w+)",
}
# Absolute words, negations and hedges of reasoning steps.
NEGATIONS = "not no never without fail wrong incorrect false opposite"
HEDGES = "however despite although nevertheless but conversely counter exception"

# Words of high stakes (importance), absolute words (reasoning), relational words (analogies).
HIGH_STAKES = """critical urgent important essential crucial vital emergency alert warning error failure bug crash
decision decided resolved agreed committed approved rejected cancelled blocked
discovered learned found realized understood identified determined confirmed verified proven
security vulnerability exploit breach authentication deadline release deploy rollback migration breaking
impact affect change update fix patch regression performance memory leak bottleneck"""
ABSOLUTES = "always never all none every impossible certainly definitely guaranteed proven"
RELATIONAL = """causes cause caused causing leads lead leading because since therefore hence thus
prevents prevent blocked blocks enables enable allows allow requires require needs need
follows follow followed after before produces produce generates generate reduces reduce decreases decrease
increases increase amplifies amplify results result outcome outputs through despite without unless
triggers trigger activates activate inhibits inhibit suppresses suppress"""
ANALOGY_STOP = "a an the and or in on to for of with by from is was are be it this that"
# Words that conversation summaries leave out.
TALK_STOP = "a an the and or but in on at to for of with is are was were i you he she it we they not so that this my your if as be do did can will just me him her them us"
# Words that clusters of texts leave out.
CLUSTER_STOP = """a an the and or but in on at to for of with by from is are was were be been being have has had
do does did will would shall should may might can could i you he she it we they me him her us them
this that these those not so if as up out into its their our my your his also than then when where"""
# Words and what stands in their place when a belief is inverted, in the order they are tried.
OPPOSITES = {
    "increases": "decreases", "decreases": "increases", "better": "worse", "worse": "better", "high": "low", "low": "high", "strong": "weak", "weak": "strong",
    "positive": "negative", "negative": "positive", "always": "never", "never": "always", "more": "less", "less": "more", "beats": "loses to", "wins": "loses",
    "rising": "falling", "falling": "rising", "bullish": "bearish", "bearish": "bullish",
}
# Words of structure that hypotheses carry from one domain to another.
STRUCTURE = "causes leads prevents enables blocks increases decreases correlates predicts triggers follows precedes"
