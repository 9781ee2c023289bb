"""The controlled vocabularies of classification, importance and grounding. All lists here are fixed values: results depend on
every entry."""

# Words of a category (2 points each), phrases (5), parts of an address's path (6).
POLITICS = (
    "inec apc pdp lp nnpp senate senator governor governorship election elections ballot electoral impeach impeachment tinubu shettima assembly "
    "lawmaker lawmakers reps constituency minister ministerial cabinet presidency aso villa campaign primaries defection coalition polls "
    "gubernatorial councillor referendum tribunal obi atiku"
).split()
POLITICS_PHRASES = [
    "national assembly", "house of representatives", "state house", "federal government", "political party", "presidential candidate", "local government election",
    "supplementary election", "the presidency", "party primaries", "vote of no confidence", "state assembly", "peoples democratic party", "all progressives congress",
]
POLITICS_PATHS = "/politics /political /election /elections /govt".split()

BUSINESS = (
    "naira cbn inflation gdp nbs economy economic forex fx dollar exchange bank banks banking loan loans debt budget revenue tax taxes firs customs "
    "tariff oil crude opec nnpc petrol fuel subsidy diesel market markets stocks equities ngx investors investment trade export exports import "
    "imports sec pension insurance fintech recapitalisation recapitalization eurobond imf afdb remittances manufacturers manufacturing cement "
    "profit earnings dividend shareholders turnover pmi"
).split()
BUSINESS_PHRASES = [
    "central bank", "monetary policy", "interest rate", "exchange rate", "foreign exchange", "world bank", "capital market", "stock exchange", "cost of living",
    "purchasing power", "food prices", "minimum wage", "gross domestic product", "fuel subsidy", "balance of payments", "monetary policy committee",
    "bureau de change", "national bureau of statistics",
]
BUSINESS_PATHS = "/business /economy /money /finance /markets /energy".split()

TECHNOLOGY = (
    "startup startups fintech app apps software ai artificial developer developers tech technology telecom telecoms ncc broadband internet 5g "
    "smartphone android ios cybersecurity hacker hackers data cloud saas crypto cryptocurrency bitcoin blockchain ecommerce seedfunding vc openai "
    "google microsoft meta nitda digital platform algorithm chip chips semiconductor starlink mtn airtel glo"
).split()
TECHNOLOGY_PHRASES = [
    "artificial intelligence", "machine learning", "series a", "series b", "seed round", "venture capital", "data centre", "data center", "digital economy",
    "mobile money", "payment gateway", "tech ecosystem", "raised $", "cyber attack", "data breach", "social media platform", "electronic payment", "open banking",
]
TECHNOLOGY_PATHS = "/tech /technology /innovation /startups /digital".split()

SPORTS = (
    "football soccer match matches goal goals striker midfielder defender goalkeeper coach manager squad fixture fixtures league cup afcon fifa caf "
    "uefa nff npfl eagles falcons olympic olympics athletics sprinter boxing basketball nba tennis cricket golf transfer arsenal chelsea liverpool "
    "barcelona madrid osimhen lookman iwobi chukwueze kickoff penalty qualifier qualifiers trophy champions relegation derby"
).split()
SPORTS_PHRASES = [
    "super eagles", "super falcons", "premier league", "champions league", "world cup", "africa cup of nations", "nigeria professional football league",
    "transfer window", "half time", "full time", "man of the match", "flying eagles", "golden eaglets", "d'tigers",
]
SPORTS_PATHS = "/sport /sports /football /soccer".split()

ENTERTAINMENT = (
    "nollywood afrobeats movie movies film films cinema album single song songs music musician singer rapper artiste actress actor celebrity concert "
    "tour grammy amvca bbnaija reality netflix showmax premiere wizkid davido burna tems rema asake ayra tiwa comedian skit fashion streaming box "
    "chart charts"
).split()
ENTERTAINMENT_PHRASES = [
    "big brother naija", "box office", "music video", "record label", "movie premiere", "red carpet", "award show", "billboard chart", "the headies",
    "entertainment industry", "new album",
]
ENTERTAINMENT_PATHS = "/entertainment /nollywood /celebrity /music /lifestyle /arts".split()

WORLD = (
    "ukraine russia gaza israel palestine nato eu brussels washington beijing moscow kyiv tehran iran china india brazil ghana kenya ethiopia sudan "
    "niger mali senegal cameroon un unicef unhcr trump biden putin zelensky macron starmer xi summit sanctions ceasefire airstrike diplomacy"
).split()
WORLD_PHRASES = [
    "united nations", "european union", "white house", "security council", "african union", "foreign minister", "prime minister", "state department",
    "international court", "world health organization", "global summit", "peace talks", "g20", "g7",
]
WORLD_PATHS = "/world /international /global /africa /foreign".split()

NIGERIA = (
    "nigeria nigerian nigerians lagos abuja kano rivers kaduna enugu ibadan oyo ogun delta anambra borno benue plateau sokoto zamfara katsina bayelsa "
    "imo abia ekiti ondo osun kwara niger taraba yobe adamawa bauchi gombe jigawa kebbi nasarawa ebonyi cross akwa efcc icpc police nscdc nafdac "
    "ndlea frsc jamb waec neco asuu nlc kidnappers bandits insurgents herdsmen community residents flood collapse"
).split()
NIGERIA_PHRASES = [
    "federal capital territory", "state government", "nigeria police force", "nigerian army", "road safety", "trade union congress", "academic staff union",
    "local government area", "south east", "south west", "north east", "north west", "north central", "south south", "niger delta",
]
NIGERIA_PATHS = "/news /nigeria /metro /national /local /education /health".split()

# Section labels that stand for a category.
SECTION_NAMES = {
    "economy": "business", "money": "business", "finance": "business", "tech": "technology", "innovation": "technology", "football": "sports", "sport": "sports",
    "showbiz": "entertainment", "celebrities": "entertainment", "international": "world", "foreign": "world",
}

# Wording of high impact, parts of opinion addresses, wording of routine notices, source types that are no reporting.
IMPACT = [
    "breaking", "dies", "died", "death toll", "killed", "explosion", "crash", "resigns", "sacked", "arrested", "convicted", "sentenced", "declares",
    "state of emergency", "strike", "shutdown", "collapse", "devalued", "emergency", "attack", "abducted", "kidnapped", "flood", "outbreak", "verdict", "ruling",
    "swears in", "suspended", "impeached", "curfew",
]
OPINION_PATHS = "/opinion /columnist /columns /editorial /viewpoint /perspective /blog /analysis /letters".split()
ROUTINE = [
    "urges", "commends", "felicitates", "congratulates", "lauds", "hails", "charges", "tasks", "calls on", "harps on", "reiterates", "restates", "seeks support",
    "advocates", "pledges support", "assures", "woos", "flags off", "inaugurates committee", "pays courtesy",
]
NO_REPORTING = ["EXPERT", "CREATOR", "SOCIAL_SIGNAL", "UNVERIFIED"]

# Words that a faithful text may add to its material, and words that initials leave out.
GROUNDED = (
    "the this that which who whom nigeria nigerian nigerians monday tuesday wednesday thursday friday saturday sunday january february march april may june "
    "july august september october november december government state federal national country report reported according said says statement announced "
    "authorities officials"
).split()
INITIALS_SKIP = "of the and for in on at".split()
