"""Word lists of the abuse features, and a labelled table beside the moderators' sample, made by a grammar.

The lists hold single words of several languages by what they mean. They were written from general knowledge, not from
any log, and are only hints whose weight is learned. Rows of the table are composed of rules with [alternatives] and
{slots}; a slot takes a word of a list or a made-up name. RULES can be held out to see how the model does on forms of
abuse, and on harmless talk, that it was never shown.
"""

from __future__ import annotations

import random

from tracewright.llm import pii_table

#: what a word may mean
LEXICONS: dict[str, str] = {
    "insult": """idiot idiots moron morons imbecile imbeciles loser losers dumbass dumbasses bastard bastards asshole assholes arsehole scumbag scumbags scum jerk jerks creep creeps freak freaks retard retards cretin clown clowns
 bitch bitches cunt twat wanker prick dickhead whore slut pig pigs swine fool fools dimwit halfwit nitwit dunce buffoon bozo weirdo psycho lunatic coward maggot worm leech douche douchebag tosser muppet numpty dolt dork simpleton
 trottel vollidiot arschloch idioten depp penner wichser hurensohn missgeburt spast dummkopf schwein versager dreckskerl mistkerl schlampe arsch drecksack vollpfosten hohlkopf
 imbécil idiota idiotas payaso gilipollas cabrón cabron pendejo inútil tonto tonta estúpido estupido puta perra zorra subnormal capullo mamón malparido
 connard connasse salope abruti abrutie imbécile crétin bouffon ordure pute enculé débile tocard minable stronzo coglione bastardo cretino puttana deficiente scemo idioot klootzak eikel sukkel mongool debil kretyn otário babaca""",
    "bad": """pathetic worthless useless disgusting ugly stupid dumb brainless hopeless spineless pitiful rotten gross filthy repulsive revolting hideous vile nasty fat stinking smelly brain-dead braindead brained talentless unwanted unlovable dumber stupider uglier
 hässlich hasslich dumm wertlos erbärmlich elend elendes elender nutzlos widerlich ekelhaft blöd fett asqueroso repugnante feo fea patético inservible gordo asco nul nulle moche laid répugnant pathétique stupide inutile débil schifoso brutto inutili lelijk dom waardeloos feio burro""",
    "waste": "waste oxygen trash garbage rubbish piece shit crap disgrace failure mistake joke nothing zero nobody abortion stain dump stück dreck scheiße mierda basura merde déchet rien nichts nada niente",
    "brain": "brain brains iq smarter smart intelligence clever brainpower cerebro cerveau gehirn hirn wit wits intelligent mirror embarrassment embarrassing ashamed shame dumber stupider",
    "hate": "hate hates hated despise despises detest loathe sick hasse hasst odio odia odian déteste déteste hais odio vomit puke laughs",
    "love": "like likes love loves miss misses missed need needs want wants wanted respect respects care cares friend mag liebt quiere aime vermisst importa mourn",
    "never": "nobody none noone never no not nothing without niemand keiner nadie nunca personne jamais nessuno ohne sin sans better happier nicer worse cleaner",
    "hush": "shut stfu gtfo fuck piss quit uninstall leave vanish disappear cry whine begone lost away mouth fresse maul klappe schnauze verpiss cállate callate lárgate gueule ferme casse dégage stai zitto zitta bek hau ab",
    "self": "kys kysnow suicide selbstmord mátate matate suicídate suicide-toi bleach noose wrists",
    "own": "yourself urself yourselves dich selbst rope bridge cliff roof hang drown jump",
    "die": "die dies died death dead drop rot burn burns burned burning choke suffocate bleed bleeding cancer suffer grave coffin hell stirb sterben verrecke krepier muere mueras muérete morir crève crever mourir muori morire sterf funeral",
    "harm": "kill killing murder beat hit punch stab shoot cut hurt break smash strangle choke slap kick crush destroy rape slit burn skin gut bash whip hunt find catch drown poison hang töten schlagen umbringen fertig matar pegar golpear romper tuer frapper buter ammazzo uccidere schiet doden",
    "limb": "legs leg neck face teeth throat bones arms jaw head skull spine nose fingers knees ribs eyes beine fresse hals piernas cara cuello dientes jambes gueule cou",
    "weapon": "knife gun blade rifle pistol bat machete hammer fists fist bullet messer waffe cuchillo pistola couteau flingue coltello",
    "menace": "regret pay scared afraid sorry watch revenge coming come house home door school address live family mother sister kids tonight hospital outside alone sleep wait fear bereuen angst familie casa familia miedo maison famille",
    "hope": "hope hopefully wish pray someone somebody should deserve deserves deserved must hoffentlich hoffe sollte ojalá espero j'espère spero favour favor",
    "kin": "mother mom mum father dad sister brother parents family wife daughter son mutter madre mère padre hermana familia famille dog",
    "group": """foreigner foreigners immigrant immigrants outsider outsiders migrant migrants refugee refugees infidel infidels heathen heathens unbeliever unbelievers gypsy gypsies jew jews muslim muslims christian christians hindu hindus black blacks white whites arab arabs asian asians african africans mexican mexicans
 gay gays lesbian lesbians trans queer women woman disabled natives strangers minority minorities race races tribe tribes ethnicity believers folk folks people peoples kind country nation religion accent skin
 ausländer auslander flüchtlinge fluchtlinge juden moslems schwarze frauen extranjero extranjeros inmigrante inmigrantes moros negros judíos mujeres étranger étrangers etrangers immigré immigrés arabes noirs juifs femmes stranieri immigrati migranten buitenlanders""",
    "vermin": "vermin subhuman subhumans parasite parasites cockroach cockroaches roaches rats rat savage savages filth filthy plague pest disease diseases cancer infestation inferior animals animal beasts apes monkeys dirt dirty breed breeding stink smell smells uncivilised uncivilized primitive blood genes abschaum ungeziefer untermenschen dreck ratten ratas plaga bestias escoria rats vermine parasites racaille ratti feccia ongedierte",
    "crime": "thieves thief liars liar steal steals criminals criminal rapists terrorists lazy ruin invade infest cheat cheats verbrecher diebe lügner ladrones mentirosos criminales voleurs menteurs criminels ladri",
    "remove": "exterminate exterminated eradicate eradicated genocide lynch lynched deport deported expel purge cleanse wipe wiped gas gassed hang hanged slaughter slaughtered removed remove eliminate eliminated exclude banish kick throw raus pure fuera vertreiben abschieben echar expulsar dehors virer fuori weg",
    "every": "all every each typical these those such any alle todos todas tous toutes sämtliche",
    "rights": "right rights exist live deserve deserves vote breathe allowed belong welcome decent here own earth land house country town guild near pure world leben recht land derecho tierra droit terre",
    "gone": "out back away gone off lost last never-again anymore enough stay keep let throw kick leave send go gehen weg zurück fuera dehors via",
    "intimate": "together tonight alone private lonely dream dreams naughty night secret sheets pillow massage shower blush flirt flirty crush snuggle noche nuit nacht heute",
    "sex": """sex sexy sexual nudes nude naked porn porno pornos xxx nsfw cybersex cyber sexting sext horny masturbate masturbating orgasm blowjob handjob anal cum milf hentai erotic erotica kinky fetish threesome hookup bdsm lewd fap slutty topless stripper strip escort condom erection aroused moan moaning
 nacktbilder nackt nackte nacktfotos geil ficken bumsen blasen wichsen erotik desnuda desnudo desnudas follar coger cachondo cachonda caliente sexo porno mamada nue nues nu baiser sexe sucer bander nudo nuda scopare sesso neuken naakt pelado transar""",
    "body": "boobs boob tits titties titty dick dicks cock penis pussy vagina ass butt booty arse breasts breast nipples nipple balls thighs thigh legs lips bra panties underwear lingerie underneath bare titten brüste arsch hintern muschi schwanz tetas pechos culo polla coño pezones seins cul chatte bite fesses tette cazzo figa kont lul bunda peito",
    "desire": "touch touching lick licking kiss kissing taste squeeze rub rubbing suck sucking ride riding spank caress undress cuddle bed sleep hot wet hard dirty thinking body baby babe cutie sweetie honey daddy turned bedroom seduce anfassen lecken ausziehen küssen tocar lamer besar chupar quítate toucher lécher embrasser déshabille toccare leccare wearing clothes slowly",
    "ask": "send show give post mail want wanna looking dm pm whisper cam webcam voice pics pic pictures photo photos video videos clip clips swap trade join irl tonight see watch schick zeig bilder fotos foto manda mándame mandame enseña envoie montre photos mostra mandami stuur",
    "girl": "girl girls boy boys teen teens chick chicks guy guys gf bf girlfriend boyfriend lady ladies mädchen chica chicas fille filles ragazza meisje",
    "swear": "fuck fucking fucked fuckin shit shitty damn damned bloody crap hell bullshit ass arse wtf goddamn freaking scheiße scheisse verdammt mist joder carajo coño putain bordel cazzo kut merda",
    "violence": "kill killed kills killing die died dies dead shoot shot attack burn burned blow bomb hang hit fight murder blood bleed destroy slay slain stab smash raid war hunt hunted sword bow arrow arrows explode",
    "play": "boss bosses mob mobs quest quests spawn biome biomes lava tnt redstone horse horses cow cows goat goats chicken chickens bug lag door lever target egg eggs texture model guide level levels xp roll farm item items loot armor armour potion potions pickaxe nether portal mine dungeon server event round score class build base shop coins map chest chests craft bake cook book page team match game world island gate tower bridge temple ship ore iron gold diamond wood stone planks",
    "report": "report reported reports reporting mute muted ban banned mods mod admin admins moderator moderators complaint language rude toxic insulted insulting insults harassing harassed harassment behaviour behavior please called calling words racist racism sexist apologise apologize rules",
    "nice": "thanks thank thx great nice good best cool welcome lovely beautiful pretty happy fun congrats gg help friendly kind awesome danke gracias merci gut bueno bien",
    "me": "i me my myself i'm im ich mich mein yo mi soy je moi mon",
}
LEXICONS["creature"] = " ".join([*pii_table.CREATURES, *(f"{c}s" for c in pii_table.CREATURES), "creeper", "creepers", "wither", "enderman", "endermen", "zombies", "villager", "villagers", "pillager", "pillagers", "elf", "elves", "dwarf", "dwarves", "orc", "orcs"])
LEXICONS["things"] = " ".join([*pii_table._THING, "lever", "clock", "map", "bed", "boat", "minecart", "elevator", "puzzle", "jump", "parkour", "update", "patch", "plugin", "machine", "piston", "hopper", "rail", "roof"])
SECOND = "you your yours yourself u ur youre you're you'd you'll y'all ya thou du dich dir dein deine deinen deiner ihr euch eres tu tú te ti tus vos vosotros usted ustedes toi ton ta tes vous votre tuo tua sei jij je jouw você seu sua".split()

RULES: dict[str, str] = {
    "abusive": """[you are|you're|ur|u are|he is|she is|{name} is] [a|an|such a|nothing but a|the biggest|just another] [{bad} |]{insult}[|, {name}| and always will be| and the whole world can see it]
[what a|such a|look at this] [{bad} |]{insult} [you are|she is|that one is|{name} is|we have here|]
[shut up|be quiet|get out|quit already|go away|crawl back|drop dead|piss off|fuck off|shut your mouth|stfu|gtfo] [you |ya |u |]{bad} {insult}
[hush|stfu|go away|fuck you|screw you|eat dirt][,|] {insult}
[you|u] [are|look|smell|sound] [so|really|utterly|too] {bad} [that|it hurts|even mirrors break|i could puke|]
[nobody|no one|not one person|no soul on earth] [here |][wants|can stand|could ever love|would miss|needs|respects] [you|a {insult} like you|a thing like you][, {insult}|, {name}|]
[everyone|everybody|the whole server|my entire team] [hates|despises|laughs at|is sick of] you[|, {name}|, {insult}]
[the server|the world|this place|life|our guild] [is|would be|will be] [better|nicer|happier|cleaner] [without you|once you are gone|if you died|the day you die]
[go |please |just |][kill|hang|drown|shoot] yourself[| already| today|, {insult}|, {name}]
kys[ {name}| {insult}| please|]
[ok|lol|hey|haha|thanks] [kys|go kys][ {name}| {insult}|]
[i hope|hopefully|i wish|let's pray] [you|your {kin}|your whole family] [die|dies|get cancer|choke|burn|rot|suffer|never wake up|bleed|get hit by a truck|lose every tooth]
[do us all a favor and|please|why don't you|you should] [die|disappear|vanish|jump off a bridge|never come back|end it|stop breathing]
[i will|i'll|i'm going to|gonna|we will|my friends will] {harm} [you|your {kin}|your face|your {limb}|you and your {kin}] [tonight|tomorrow|with a {weapon}|slowly|till you cry|until you beg|]
[i'm coming|we come|i'm on my way|i drive] [over|to your house|to your school|for you] [tonight |tomorrow |]with a {weapon}[, be scared|, sleep well|]
[i know|we know|i found out] [where you live|your address|your school] [and|,] [you will|you'll] [pay|bleed|regret it|be sorry]
[i'll|we will|my crew will] [get|catch|hunt down] you and {harm} [you|your {limb}|your {kin}]
[a|even a|my] [potato|rock|goldfish|toaster|donkey|mushroom|snail] [is smarter than|has more brains than|is worth more than|is more useful than|beats] you
[your|ur] [mother|mum|face|brain|existence|life|family] [is|was] [a|an|so] [{bad}|joke|mistake|disgrace|waste of space]
[you|people like you] make [the room|us all|this team|everyone] [dumber|stupider|uglier|more stupid] [by talking|with every word|every day|just by being here]
[you|people like you] make [me|everyone|the whole team] [sick|puke|want to vomit|ashamed|dumber]
[watch your back|sleep with one eye open|start running|you better hide], [i will {harm} you|you are dead|you will bleed|{insult}]
[hope|wish] [your house|your dog|your {kin}|your room] [burns|dies|rots|falls apart] [tonight|with you inside|soon]
[go|just] [cry|whine|choke|die|rot] [in a corner|to your mommy|alone|in hell|outside][, {insult}| you {bad} {insult}|]
[who|why] [invited|let in|hired|brought|would trust] [this|that|the] [{bad} |]{insult}[ here| to the guild| near us|]
[{insult}|{bad} {insult}] [alert|detected|spotted|again|at work][, {name}|, ignore|]
[how|what] [{bad}|much of a {insult}] [can you be|are you][, {name}|]
[quit|leave|uninstall|delete] [this game|everything|the server] [{insult}|you {insult}|you {bad} {insult}][, you wreck it all|]
[you|u] {bad} [piece|pile|sack] of [shit|trash|garbage|dirt|crap]
[we|everyone|people] [would|will] be [happier|better off|glad] [if|when] you [left|quit|stopped playing|moved away|never joined][, {name}|, {insult}|]
[why are you|how can you be|stop being] [so {bad}|such a {insult}|such a {bad} {insult}]
[your parents|your {kin}] [must be ashamed|regret you|should be ashamed|never wanted you][ of you|, {insult}|]
[if you died|when you die|at your funeral] [nobody will cry|we will laugh|no one would notice|i will dance]
[du bist|ihr seid|der ist] [ein|echt ein|nur ein|voll der] [{bad_de} |]{insult_de}[|, {name}]
[halt|haltet] [dein maul|die klappe|die schnauze][| du {insult_de}|, {insult_de}]
[du|ihr] {bad_de} [stück nichts|stück dreck|{insult_de}]
[ich bring dich um|ich schlag dich|verrecke|stirb endlich|geh sterben|niemand mag dich][, {insult_de}| du {insult_de}|]
[eres|sois] [un|una|el mayor] {insult_es}[| de mierda| y lo sabes|, {name}]
[cállate|lárgate|vete a la mierda|muérete|das pena|me das asco][, {insult_es}| {insult_es}|]
[te voy a|vamos a] [matar|pegar|romper la cara|buscar en tu casa][, {insult_es}|]
[tu es|t'es|vous êtes] [un|une|vraiment un] {insult_fr}[| fini|, {name}]
[ta gueule|ferme la|dégage|va crever|tu me dégoûtes|personne ne t'aime][, {insult_fr}| {insult_fr}|]
[je vais|on va] te [tuer|frapper|retrouver|casser la gueule][, {insult_fr}|]
[sei uno|je bent een|você é um] [stronzo|coglione|klootzak|eikel|otário|babaca|idiota]""",
    "hateful": """[all|those|these|most|typical|every one of the] {groups} [are|look like|live like] [{vermin}|{bad}|born {crime}|not human|a disease|lower than animals|too dumb to read]
[we should|you all should|let's|they should|time to] {remove} [all |every last one of |the |those |]{groups}[ from here| from our land| today|]
{groups} [must|need to|have to|ought to] [be {removed}|all die|burn|disappear|leave our country|be gone]
[people|anyone|folk] from [that country|the east|over there|{place}|{place} valley] are [a cancer|{vermin}|{bad}|{crime}|parasites][ and must go| and must be removed|]
[i|we] [hate|despise|can't stand|don't want|won't tolerate|would never trust] [all |any |these |][{groups}|{place} people] [here|in our land|near my kids|in my house|on this island][, they {smell}|]
those {groups} {smell} and [steal|lie|stink|breed|ruin everything]
[no|keep out all|never let in|ban all] {groups} [allowed here|in our guild|on our land|near us], they [smell|are {vermin}|are {bad}|steal]
[a|any] good {one} is [a dead one|a gone one|six feet under]
[go back|get back] to [your country|the desert|the jungle|{place}|wherever you came from], {one}
[send|ship|throw|kick] [them|all {groups}|every {one}|the {groups}] [back|out|into the sea|back home][, they are {vermin}|]
{groups} [have no right to|don't deserve to|were never meant to] [live|vote|breathe|be here]
[purge|burn|hang|gas|wipe out|shoot|lynch] [all|the|every one of the] {groups}[ now| on earth| and their kids|]
[keep|make] [our|this|the] [land|guild|race|blood|town] [pure|clean|free of {groups}][, no {groups}|, throw out the {groups}| and ban every {one}|]
[i|we|nobody here] [will not|would never|won't|refuse to] [let|sell to|live near|eat with|work with|rent to] [any |]{groups}[ in this town| ever| at my table|]
[there is no place|no room|no mercy] for {groups} [here|in our country|on earth|among us]
[go away|get out|leave], {groups}, [nobody wants you|this land is ours|you ruin it]
{groups} [breed|multiply|spread] like [rats|cockroaches|a plague|flies|rabbits]
[{vermin}|{crime}], [all of them|every last {one}|the whole lot][, i mean the {groups}|]
[typical|classic] {one}[,|:] [all {crime}|lazy and {bad}|{vermin} by blood|can't be trusted]
[alle|diese|sämtliche] {group_de} [sind|raus, das sind] [abschaum|ungeziefer|dreck|ratten|diebe]
{group_de} raus[, ihr {insult_de}| aus unserem land|]
[todos los|esos|fuera los] {group_es} [son|, son] [ratas|basura|escoria|ladrones|una plaga]
[tous les|ces|dehors les] {group_fr} [sont|, ce sont] des [rats|parasites|voleurs|déchets|animaux]""",
    "sexual": """[send|show|give|post|mail] [me|us] [some |your |ur |more ][nudes|naked pics|pics of your {body}|a photo of your {body}|dirty pictures|{body} pics][ please| now| tonight| on cam|, cutie| {name}|]
[let me|i want to|i wanna|can i|i'd love to|dying to] [see|touch|lick|kiss|feel|squeeze|rub|taste] [your|those|that|ur] [sweet |hot |bare |naked |wet |][{body}|body][ all over| tonight|, cutie|, babe| {name}|]
[wanna|want to|let's|anyone up to|down to] [have sex|sext|cyber|hook up|fuck|get naked|masturbate|do it|get dirty] [with me|tonight|irl|in dm|on cam|later|right now]
[anyone|any {girl}] [horny|kinky|naked|into sexting|up for cybersex|wet][ here| tonight| in pm| on voice|]
[looking for|need|searching for] a [horny|hot|naked|kinky|dirty] {girl} [for sex|to sext with|for cybersex|to play with in bed|]
[free|best|hot|new|real] [porn|xxx|hentai|sex|nude] [videos|clips|pics|site|server][ in my profile| here| join now| dm me|]
[what are you|are you] wearing [underneath|under that|any panties|nothing|a bra]
i [am|get|was] [so|really|always] [horny|hard|wet|turned on] [when i think of you|tonight|for you|reading this|]
[take off|get out of|slip off|rip off] your [clothes|shirt|panties|bra|pants] [for me|slowly|on cam|]
[i want|i need|i dream of] [you naked|your {body}|you in my bed|to sleep with you|to be inside you][ tonight| {name}|]
[suck|ride|lick|spank|fuck] [me|my {body}|it all night|your {body}]
i [touch|rub|stroke] myself [thinking of you|every night|when you talk|while we chat]
[i'd|i would] [do|bang|fuck|lick|ride] you [all night|so hard|on the table|slowly][, babe|]
[describe|tell me about] your {body} [slowly|in detail|for me]
[i need to|wanna|help me] [get off|get me off|get hot] [with someone|with you|to your voice|in private]
[wanna|let's|come and] [make out|fool around|get naughty|get it on|spend the night|share a bed|shower together|cuddle naked] [with me|tonight|on voice|in private|]
[lonely|bored], [anyone|any {girl}] [want some fun in bed|in the mood|naughty tonight|for a naked call]
[swap|trade|share] [nudes|naked pics|dirty videos|sex clips][ with me|?| in dm|]
[talk|whisper] dirty [to|with] me[ tonight| on voice|]
[schick|zeig] mir [nacktfotos|nacktbilder|deine titten|deinen arsch|deine muschi][ bitte|]
[willst du|lust auf|wer will] [ficken|sex|cybersex|nackt chatten][ heute| im dm|]
[mándame|enséñame|quiero ver] [fotos desnuda|tus tetas|tu culo|tus pechos][ por favor|]
[quieres|vamos a] [follar|tener sexo|sexo por cam][ esta noche|]
[envoie|montre] [moi |][des photos nue|tes seins|ton cul|tes fesses][ stp|]
[tu veux|on va] [baiser|coucher|faire du sexe][ ce soir|]
[mandami|fammi vedere] [foto nuda|le tette|il culo]""",
    "none": """[this|that|the] [stupid|dumb|damn|fucking|bloody|shitty|useless|pathetic|ugly|goddamn] {thing} [is stuck|broke|lags|again|won't open|ate my {thing}|needs fixing]
[i|we] [killed|shot|burned|stabbed|slaughtered|destroyed|hunted|beat] {n} {creatures} [with my {thing}|near the gate|for the quest|again|today]
[kill|shoot|attack|hunt|burn|blow up|smash|stab] [the|that|every] [{creature}|dummy|{thing}] [for|to get|with|and take] {thing}
[someone|{name}|he|a player] [called me|keeps calling people|insulted me as|yelled] [a|an] [{insult}|{bad} {insult}], [please ban|mods help|so rude|can an admin look]
[please|mods|admin|hey mods] [mute|ban|kick|warn] [him|them|that player|{name}], [rude|toxic|swearing|harassing people|bad language in chat]
[reported|muted|blocked] [{name}|that guy|two players] for [insults|racist jokes|sexual messages|bad language|harassing women]
i am [so|such a|really|too] [stupid|dumb|an idiot|useless|clumsy|bad at this], i [forgot|lost|dropped|burned] my {thing}
you [are|were] [great|the best|right|welcome|so fast|next|late|very kind|good at this|my hero][ {name}|]
[show|send|give|bring] me [your|the|a|some] [base|build|{thing}|coords|farm|shop|map|assembly line|new house]
[i want|i'd love|want] to see [your|the] [base|farm|build|new house|castle|{thing} shop]
[looking for|need] [a|one more] [partner|team|builder|healer|farmer] for [the raid|trading|the {creature}|our guild][, whisper me| dm me|]
[{groups}] [are welcome here|joined our guild|deserve respect|built a museum|are people too|made great food]
[i am|my friend is|we are] [a foreigner|an immigrant|muslim|christian|jewish|gay|black|from {place}|a refugee][ and happy here|, hello all|]
[all|those|these|the] [zombies|creepers|goblins|{creatures}|pigs|chickens] are [stupid|ugly|slow|evil|vermin|so dumb|too strong|everywhere]
[damn|shit|fuck|wtf|hell|crap|joder|verdammt|putain|scheiße][,| |!] [i died again|my {thing} is gone|the {creature} got me|lag again|that hurt|what a jump]
[that|this] [boss|level|jump|{creature}|update] is [a bastard|a bitch|hell|brutal|shit|stupidly hard|a pain in the ass]
[hot|naked|bare|wet|hard|dirty|sexy|raw] [springs|mole rat|hands|sponge|mode|water|beat|chicken|planks|wood|floor|armor stand] [are|is] [open|missing|needed|at the market|fun]
[the|a] [rooster|hen|cock|breast plate|ass cart|donkey|bull|cat|pussy willow] [is|sits] [in the barn|on the roof|for sale|near the gate]
[the|that|a|my] [naked|bare|nude|topless] [statue|model|doll|mannequin|skin|armor stand] [of|on|for|like] [a |the |]{creature} [needs|lacks|misses|gets|wears] [armor|a cape|textures|paint|a helmet]
[touch|lick|kiss|squeeze|rub|ride] the [lever|ice|frog|lemon|lamp|horse|pig|wall] [to open|for luck|and win|first]
[we|they] [breed|raise|farm|feed] [cows|rats|goats|horses|chickens|{creatures}] [behind the barn|for {thing}|near the gate]
[throw|kick|wipe|burn|clear] [out |away |][the {thing}|dead bushes|rotten flesh|cobwebs|the ball|trash] [please|in the pit|before the event|]
[the only|a] [good|dead] [{thing}|bush|tree|battery|{creature}] is [a sharp one|here|worth it|left]
[die|dice] roll [was|is] {n}, [we attack|you win|next player]
[hope|i hope] [you win|you sleep well|your trip was good|your {kin} is fine|you get the {thing}|your house is done]
[i will|i'll] [find|meet|help|beat|catch] you [at the gate|in the race|a better {thing}|a seat|later|tomorrow]
[nobody|no one] [is online|likes mondays|found the {thing}|knows the way|wants more {thing}|needs {thing}]
[your] [house|farm|roof|{thing}|{kin}] [is|looks] [lovely|great|bigger than mine|in danger, creeper|burning, hurry|on fire]
[watch|mind] your [step|head|back, {creature}|health bar|{thing}]
[my|his] [mother|sister|boss|teacher|dog] [hates|loves|is sick of|wants] [this game|spiders|rain|mondays|{thing}]
[i hate|i despise|sick of] [this rain|lag|{creatures}|mondays|this {thing}|parkour]
[go|run] [back|home|away] [to spawn|to the bridge|it's raining|before night|from the {creature}]
[kicked|banned|removed] [for lag|from the list|by mistake|after the update]
[who|what] [wants|needs|is selling] [a|some|dirty|clean] [{thing}|fight at the arena|duel|race]
[no|only] [pets|tnt|horses|{creatures}|visitors] allowed [in the shop|at night|on the bridge|here]
[sex|sexing|mating] [of chickens|the chicks|season for horses] [is|starts] [random|hard to see|in spring]
[verdammt|mist], [schon wieder tot|mein {thing} ist weg|der {creature} war da]
[du bist|ihr seid] [dran|gleich da|super|nett|schnell|der beste]
[eres|sois] [el mejor|muy amable|rápido|bienvenido|de los buenos]
[tu es|vous êtes] [le meilleur|gentil|rapide|où|prêt]
[ich bring|ich finde] [dir ein {thing}|das {thing}|dich am tor]
[te voy a|vamos a] [ayudar|dar {thing}|esperar en la torre]
[je vais|on va] [t'aider|te donner un {thing}|manger|attendre ici]
[the|my] [knife|gun|bat|hammer|blade|bow] [skin|enchant|recipe] [is|costs] [nice|{n} coins|broken]
[i come|coming] over [tonight|tomorrow] with [pizza|{thing}|my sister|snacks]
[a|the] [{thing}|bot|villager] is [smarter|faster|better] than [it looks|mine|before]
[waste|wasted|what a waste] of {thing}[, damn| again|]
[do you|who] [like|love|miss|need|want] [the old map|{thing}|rain|pizza][?|]
[i|we|they] [sold|found|ate|used|counted|moved|hid] [all|every one of|each of] [my|our|the] [{thing}|gear|tools] [near {place}|at {place}|in the lava|again|today]
[all|every|each|those|these] [{thing}|players|builders|shops|doors] [is|are|was|were] [open|gone|free|late|ready|here|sold] [now|again|at {place}|]
[back|out|away|off|gone] [again|for dinner|to work|for a week|already|in five]
[get|go|come|keep|stay] [out of the rain|off my roof|back to {place}|away from the edge|here|together|near the gate]
[everyone|you all|people|folks] [has|have|got] the right to [vote|build here|an opinion|a shop|leave]
[let's|we could|who wants to] [build|raid|play|mine|fish|race|sing] together [tonight|on voice|alone|in private|at {place}]
[let|leave|send|move|keep] [the|my|our|all] [{thing}|{creature}|dog|kids] [in|out|here|at home|near {place}]
[we don't|i don't|they don't] [want|need|have] [{thing}|more rain|a new map|pvp] here[, thanks| right now|]
[four|two|many|some] [people|women|strangers|folks] [are|were] [sitting|waiting|building|fishing|lost] [at|near] {place}
[the earth|our land|this country|the town|my house] [needs|has|gets] [{thing}|more trees|a wall|a name]
[who|did anyone] [lose|let|opened|moved|took] the [{thing}|gate|{creature}] [in|out|at {place}|here|]
[tonight|alone|together] [i|we] [build|fish|sleep at {place}|guard the {thing}|watch the stars]
[ok|thanks|lol|yes|no|gg|hi|bye|brb|wb|nice|sure]""",
}


class _Words:
    """Fills the slots; ``half`` 0 or 1 takes every other word of a list, None all."""

    def __init__(self, seed: int, half: int | None):
        self.f = pii_table._Filler(seed)
        self.half = half

    def of(self, text: str) -> str:
        words = text.split()
        return self.f.r.choice(words if self.half is None else words[self.half :: 2])

    def made(self) -> str:
        r = self.f.r
        return (r.choice(pii_table._HEAD) + r.choice(pii_table._TAIL)).capitalize()

    def slot(self, name: str) -> str:
        r = self.f.r
        lex = LEXICONS
        english = lambda c, n: " ".join(lex[c].split("\n")[0].split()[:n])
        people = "foreigners immigrants outsiders migrants refugees infidels heathens unbelievers gypsies jews muslims christians arabs asians africans gays lesbians women mexicans strangers"
        return {
            "insult": lambda: self.of(" ".join(lex["insult"].split("\n")[:2])), "bad": lambda: self.of(lex["bad"].split("\n")[0]),
            "insult_de": lambda: self.of(lex["insult"].split("\n")[2]).capitalize(), "insult_es": lambda: self.of(lex["insult"].split("\n")[3]), "insult_fr": lambda: self.of("connard abruti imbécile crétin bouffon enculé tocard débile"),
            "bad_de": lambda: self.of("hässliches dummes wertloses erbärmliches elendes nutzloses widerliches blödes"),
            "name": lambda: self.f.player(), "kin": lambda: self.of(english("kin", 12)), "limb": lambda: self.of(english("limb", 18)), "weapon": lambda: self.of(english("weapon", 11)),
            "harm": lambda: self.of("kill murder beat hit punch stab shoot cut hurt break smash strangle slap kick crush destroy burn bash drown poison"),
            "groups": lambda: self.of(people) if r.random() < 0.5 else f"{self.made()} {r.choice(['people', 'folk', 'believers', 'tribe', 'clan'])}" if r.random() < 0.5 else self.made() + r.choice(["s", "i", "ans", "ites", "ari"]),
            "one": lambda: self.of("foreigner immigrant outsider migrant refugee infidel heathen gypsy jew muslim arab asian") if r.random() < 0.4 else self.made() + r.choice(["", "i", "an", "ite"]),
            "group_de": lambda: self.of("ausländer flüchtlinge juden moslems schwarze"), "group_es": lambda: self.of("extranjeros inmigrantes moros negros judíos"), "group_fr": lambda: self.of("étrangers immigrés arabes noirs juifs"),
            "vermin": lambda: self.of(english("vermin", 30)), "crime": lambda: self.of("thieves liars criminals rapists terrorists cheats"), "smell": lambda: self.of("smell stink breed steal lie cheat"),
            "remove": lambda: self.of("exterminate eradicate lynch deport expel purge gas hang slaughter eliminate banish"), "removed": lambda: self.of("exterminated eradicated deported hanged gassed slaughtered removed eliminated shot wiped"),
            "body": lambda: self.of(english("body", 30)), "girl": lambda: self.of("girl boy teen chick guy lady"), "place": self.made, "n": lambda: str(r.randrange(2, 99)),
            "thing": lambda: self.of(lex["things"]), "creature": lambda: r.choice(pii_table.CREATURES), "creatures": lambda: r.choice(pii_table.CREATURES) + "s",
        }[name]()

    def row(self, rule: str) -> str:
        return pii_table._SLOT.sub(lambda m: self.slot(m[1]), pii_table.expand(rule, self.f.r)).strip(" ,")

    def disguised(self, text: str) -> str:
        """Letters of a word stretched, masked, set apart or written in signs and look-alikes."""
        r = self.f.r
        words = text.split(" ")
        k = max(range(len(words)), key=lambda i: (len(words[i]) > 3 and r.random() < 0.8) * len(words[i]) + r.random())
        w = words[k]
        if len(w) > 3 and w.isalpha():
            i = r.randrange(1, len(w) - 1)
            words[k] = r.choice([w[:i] + w[i] * r.randrange(3, 6) + w[i + 1 :], w[:i] + "*" + w[i + 1 :], " ".join(w), ".".join(w), w.translate(str.maketrans("oieast", "013457")), w.translate(str.maketrans("aeopcx", "аеорсх")), w[:i] + "​" + w[i:]])
        return " ".join(words)


def rules(kind: str, part: int | None = None, parts: int = 4, inside: bool = True) -> list[str]:
    found = RULES[kind].splitlines()
    return found if part is None else [x for k, x in enumerate(found) if (k % parts == part) == inside]


def labelled_table(seed: int = 11, each: int = 18, part: int | None = None, inside: bool = True, half: int | None = None) -> list[tuple[str, int]]:
    """``each`` rows of each rule with their label, some disguised, in capitals, or with a tail."""
    w = _Words(seed, half)
    r = w.f.r
    rows = []
    for kind in RULES:
        for rule in rules(kind, part, inside=inside):
            for _ in range(each if kind != "none" else 2 * each):
                text = w.row(rule)
                x = r.random()
                if x < 0.12:
                    text = w.disguised(text)
                elif x < 0.2:
                    text = text.upper()
                if r.random() < 0.2:
                    text += r.choice(["!", "!!", ".", " lol", " :)", " ok?", "..."])
                rows.append((text, int(kind != "none")))
    chat = [x for x in pii_table.RULES["none"].splitlines() if "{rude}" not in x]
    rows += [("".join(s for s, _ in pii_table.fill(pii_table.expand(x, r), w.f)), 0) for x in chat for _ in range(each)]
    return rows
