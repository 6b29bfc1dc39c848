"""The labelled table that the personal-information model is trained from, made by a grammar.

A row is composed of clauses: openers, carriers of personal information or harmless talk, tails. A clause is a rule
with [alternatives], |-separated, and {slots}; slots are filled from formats of several countries and short lists by a
seeded generator, so every token has a label. Rules are general statements of how people give such things away in
several languages, and of what they say about a game otherwise; none was taken from a log. Names, numbers and places
are invented. RULES of one kind can be held out to see how the model does on sentences it was never shown.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "identity", "address", "person")

#: given names which the model knows as such, of many places
GIVEN = """aaron abdul abigail ada ahmed aiko akira alan albert alejandro alexander alfred ali alice amina amy anders andrew angela anita anna antonio arjun
ayse barbara beatriz benjamin bernard brian bridget camila caroline catherine charlotte chidi christina claudia daniel david deborah dennis diego
dominik dorothy edith eduardo edward elena elizabeth emily emma eric esther eva fatima felix fernando francesca francois frank frederik gabriel george
gerard giovanni giulia grace greta gustavo hannah harold heather heinrich helen henry hiroshi ian ibrahim ingrid isabel jack jacob james jan jane
jasmine jean jennifer jessica joan johanna john jonas jorge joseph juan julia karen karl katarina keiko kenji kevin kofi kwame lars laura leila leon
linda lucia luigi luis magdalena manuel marco margaret maria marie mark martin mary matthew mei melissa michael miguel minh mohammed monica nadia nancy
natalia nguyen nicole nikolai nina oliver olivia olu oscar pablo patricia paul pedro peter philip pierre priya rachel raj ravi rebecca richard robert rosa
rudolf ruth samuel sandra sanjay sara sebastian sofia stefan stephanie steven susan sven thomas ursula victor wei william yuki yusuf zoe""".split()
#: given names which it doesn't know, so that the list above stays a hint
_GIVEN_MORE = """adaeze agnieszka alistair amarachi anselm aoife apinya ashok augusta babak bartek benedetta birgit bogdan caspian chiara ciaran clemens cosima dagmar
darius deniz dragana eamon eilidh ekaterina elodie emeka eirik fabrizio farah fergus fumiko gianni gilles goran gwen hamza haruto heloise hilde ignacio ilse imani
imogen ivana jarek jelena joaquin jolanta kaito katrin keziah khadija klaus ladislav leopold lieke liesbeth ljubica lorenzo maarten maeve malik mareike matilda mehmet
mireille montserrat nikhil noor oleksandr ottilie parisa pascal piotr quentin radka ragnar renata rhys rosalind ruben saoirse sergei shanelle shinji siobhan sunita
tadeusz tamsin tariq thandiwe tobias torsten tomasz tuan ulrike vasily vikram wanjiru wilhelmina xavier yolanda yannick zainab zbigniew zoltan""".split()
#: family names; others are composed of the syllables below
_FAMILY = """abbott adeyemi akhtar alvarez andersson antonelli arslan bailey banerjee barros beaumont becker benitez bianchi boateng brandt campbell carvalho castillo chandra
chavez chen clarke costa craig dasgupta delgado desmond diallo dimitrov dubois duarte eriksson esposito farouk ferrari fischer fitzgerald fontaine fraser
friedrich fujimoto gallagher garcia gupta haddad hansen hartmann hashimoto henderson herrera hoffmann holloway hughes ibarra iyer jankowski jimenez johansson
kamara kaplan kaur keller kim kowalski krause kumar laurent lefebvre lindqvist lombardi lopez macdonald mahmoud maier marchetti martinez mbeki mcallister mehta mendoza
mensah moreau morrison mueller murphy nakamura navarro nielsen novak nwosu obrien okafor oliveira olsen ortega osei papadopoulos park patel pereira petrov pham popescu
ramirez rasmussen reyes ricci richter robinson romano rossi sanchez sandhu santos schmidt schneider schuster sharma silva simmons smith sorensen steinmetz
suzuki svensson takahashi thompson torres tran tremblay vasquez vogel wagner walker wang weber wójcik yamada yilmaz zhang zimmermann""".split()
_HEAD = "ab al ar bal bar bel ber bran cal car cas cor dal dar del dor ed el fal fer gal gar har hen hol kar kel ker kos lam lar lin lor mal mar mel mor nak nor ol or pal pan per ran ros sal san sel ser sten sul tal tan tar thor tor ul van var vel ver wal wel win yam zan zim".split()
_TAIL = "ak aki ama ander ano aro ars berg bridge by dale den dorf eau ek ell ello ens er ero eva ez field ford gate ham hart house ic ide ier ij in ini ino is ita iz ley ler lin lock low man mann mont more ney nik off oka ola one os ota ov ova ow rell rick ridge ros sen shaw ska ski son stad stein sted stone strom ton uk ula va vic ville wall ward well wood worth yan yk".split()
_TITLE = "dr dr. mr mr. mrs mrs. ms prof prof. herr frau señor señora monsieur madame sig. mevrouw".split()
_PARTICLE = "van de von di da del bin al la le dos ter".split()

_STREET = "Acacia Albany Baker Beech Bishop Broad Brook Burgundy Carlton Chestnut Clover Copper Cromwell Dover Eagle Fairview Fern Fleming Franklin Grange Grove Hampton Hawthorn Heron Holly Imperial Ivy Jubilee Kestrel Lakeside Laurel Lavender Lincoln Linden Maple Mercer Monroe Oakwood Orchard Palmer Parkside Pennsylvania Poplar Prince Priory Queens Regent Riverside Rosewood Saint School Sherwood Spruce Station Summer Sycamore Temple Thornton Union Vernon Victoria Walnut Washington Wellington Windsor Woodland York".split()
_STREET_KIND = "Street St St. Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Terrace Row Way Close Place Pl Crescent Boulevard Blvd Square Gardens Hill Mews Parade Grove Walk Green Circle Parkway".split()
_GERMAN = "Ahorn Amsel Bahnhof Birken Brunnen Buchen Burg Dorf Eichen Fichten Garten Goethe Haupt Kastanien Kloster Mozart Markt Mittel Mühl Post Ring Schiller Schul See Sonnen Stein Tannen Tulpen Wald Wasser Wein Zeppelin".split()
_GERMAN_KIND = "straße strasse str. weg gasse allee platz ring damm ufer steig".split()
_NORTH = "Kerk Molen Nieuwe Oranje Station Storg Kung Drottning Skol Søndre Norre".split()
_NORTH_KIND = "straat laan weg plein kade gatan vägen gata veien gade vej".split()
_LATIN = "rue|avenue|boulevard|chemin|impasse|place|allée|calle|avenida|paseo|plaza|camino|carrera|via|viale|piazza|corso|rua|travessa|praça".split("|")
_LATIN_NAME = "de la République;de l'Église;du Commerce;des Acacias;Victor Hugo;Jean Jaurès;Pasteur;de la Liberté;Cervantes;del Carmen;de los Reyes;Colón;Independencia;San Martín;de Alcalá;Garibaldi;Dante;dei Mille;della Vittoria;Verdi;Cavour;das Flores;do Comércio;Augusta;Nova;de Goya;Lafayette;du Port".split(";")
_TOWN = "Ashbourne Brackenfurt Calderon Dunmore Eberfeld Fontclair Grimsley Hollenbeck Inverloch Jorvik Kirchau Lowell Montaigu Norwood Oldenhof Portsea Quimbley Rivermouth Sandvik Tavira Umberleigh Valmont Weston Zellheim".split()
_COUNTRY = "Austria Belgium Canada Denmark Ireland Norway Portugal Spain Sweden Texas Ohio Kent Bavaria".split()
_HOST = "mail post inbox office school uni work company web box letters family club team dev studio mailbox clinic bank shop home corp lab".split()
_END = "com org net de fr es it co.uk eu io info edu example test invalid nl pl ca com.br se".split()
_DIGIT = "zero one two three four five six seven eight nine".split()

_ADJECTIVE = "ancient amber bitter black blue bold bright broken bronze burning calm cold crimson cruel crystal dark deep dire dread dusty elder emerald empty fallen far feral flaming foul frozen ghost gilded giant glass golden gray green grim hidden high hollow howling icy iron ivory jade lonely lost lower lunar mad misty mossy mystic northern obsidian old pale phantom proud purple quiet red royal ruby rusty sacred salty scarlet shadow shattered silent silver sleepy smoky southern spectral stone storm sunken swift tall twisted upper velvet vile white wicked wild windy winter withered".split()
CREATURES = "archer basilisk bat bear beetle boar centipede crab crawler cyclops demon dragon drake eel elemental ent fiend gargoyle ghoul giant goblin golem gryphon harpy hound hydra imp king knight kraken lich lizard lurker mage manticore minotaur moth ogre phoenix prowler queen raider reaper revenant scorpion sentinel serpent shade shaman skeleton spider spirit sprite stalker titan toad troll viper warden warlock weaver wisp witch wolf wraith wyrm yeti zombie".split()
LANDFORMS = "abbey alley arch archipelago atoll bank barrens basin bay beach bluff bog bridge brook canal canyon cape castle cathedral cave cavern chasm city cliff coast coves creek crossing dam delta desert docks dunes falls farm fen field fields fjord ford forest fort fortress garden gate geyser glacier glade glen gorge grotto grove gulf hall harbor harbour haven heath highlands hill hills hollow island isle jungle keep lagoon lair lake landing ledge lighthouse manor market marsh meadow mesa mill mine mines monastery moor mountain oasis orchard outpost palace pass path peak peaks pier pit plains plateau plaza point pond port prairie quarry rapids ravine reef ridge river rock ruins sanctuary sands sea shore shrine slope spire spring springs square station steppe summit swamp temple tower town tundra tunnel valley vault village volcano wall waterfall wharf wilds wood woods".split()
_THING = "acorns anvils arrows axes bamboo banners barrels beacons beds bees beetroot berries boats bones books boots bottles bowls bread bricks buckets cakes candles carpets carrots chains chests clay coal cobble cocoa compass concrete cookies copper coral crops crystals diamonds doors drums dust dye eggs emeralds feathers fences fern fish flint flowers furnaces gems glass gold gravel gunpowder hay helmets hoes honey hooks horses ingots iron ivy kelp keys ladders lamps lanterns leather levers lilies logs looms maps melons minecarts moss mushrooms nails nuggets oak obsidian pans paper pearls pickaxes pies pipes planks plates potatoes potions pumpkins quartz rails rods ropes rope roses saddles sand saplings seeds shards shells shields shovels signs silk slabs slime snow spears sponges sticks stone string sugar swords tablets tiles tools torches tridents vines wands wax wheat wood wool".split()
#: words of the game's world
GAME = [*_ADJECTIVE, *_THING, *(t[:-1] for t in _THING if t.endswith("s")), *(f"{c}s" for c in CREATURES)]
_BADGE = "Amulet Banner Blade Book Bow Charm Chest Chalice Compass Crown Cup Event Festival Gem Guild Hammer Horn Key Lantern League Map Mask Medal Mirror Orb Quest Race Relic Ring Rune Scroll Season Shard Shop Staff Stone Sword Throne Tome Tournament Trophy Update".split()
_DID = "built broke burned bought carried caught cleared closed copied crafted dropped dug enchanted explored farmed filled fixed flooded found gave grew guarded hid killed lit lost mined moved opened painted placed planted raided repaired saved sold stacked stole swapped tamed took trapped used watered".split()
_DO = "build break bring buy carry catch clear close copy craft drop dig enchant explore farm fill fix flood find grow guard hide kill light lose mine move open paint place plant raid repair save sell stack steal swap tame take trap use water".split()
_DAY = "monday tuesday wednesday thursday friday saturday sunday january april june august october december".split()
_TONGUE = "english german spanish french italian dutch polish turkish russian japanese chinese portuguese".split()
_PLAYER_A = "able brave calm clever cosmic crazy daring eager epic fancy fierce funny giga happy hyper icy jolly lazy loud lucky magic mega micro nimble noble odd pixel pro quick rapid robo shy silly sleepy slim sly sonic super tiny toxic turbo ultra vivid witty zany".split()
_PLAYER_B = "ace badger beaver bison bunny camel cat cobra coyote crow deer dingo dodo eagle ferret finch gecko goose hero hippo jaguar koala lemur lion llama moose monkey ninja otter panda parrot penguin pirate puma quail raven rhino robin shark sloth squid stork tiger toad turtle viking walrus weasel wizard wombat zebra".split()
_NOTE = "anyone everybody guys lads mates folks people team friends nobody somebody admin mods newbies builders miners traders".split()

#: rules by kind; a row takes one of them as its carrier
RULES: dict[str, str] = {
    "email": """[please|just|you can|feel free to] [email|mail|write to|message] [me|us|my brother|our coach|the office] [at|on|under|via] {email}
[the best|a quick|the only] [way|place] to [reach|contact|find] [me|us|her] is {email}
[forward|send|post|drop|upload] [it|them|the screenshots|the invoice|a copy|everything|the video] to {email}
[his|her|their|our|dad's|my new|my second] [email|e-mail|mail address|inbox|gmail|work mail|school email] [is|was|should be|=|:|->] {email}
{email} [works|is fine|bounces|is mine|still exists|gets read daily]
{email} [is|was] [his|her|our|the new|a valid|my old] [address|contact|mail|inbox]
[sign up|log in|register|subscribe] [with|using] {email} [and|then] [wait|check spam]
[mail|email|e-mail|mailto|kontakt|correo|courriel][:| -| =] {email}
[schreibt|mailt|antworte] [mir|uns|ihm] [unter|auf|bitte an] {email}
[ihre|seine|unsere|meine] [mail|e-mail|mailadresse|adresse] [lautet|ist|war] {email}
[escríbeme|escribe|mándalo|envíalo|responde] [a|al correo|al mail] {email}
[mi|su|nuestro] [correo|email|mail] [es|era|sería] {email}
[mon|notre|son] [courriel|mail|adresse mail|e-mail] [c'est|est|:] {email}
[envoie|écris|transmets] [moi ça|le tout|un message] [à|sur] {email}
[scrivimi|mandalo|rispondi] [a|all'indirizzo] {email}
[stuur|mail] [het|alles|dat] [naar|aan] {email}
[o meu|meu|nosso] [email|e-mail|correio] é {email}
[invite|add|cc|include] {email} [on|in|to] the [doc|calendar|form|mailing list|newsletter]
[both|try] {email} [or|and] {email}
[i got|we got|there came] [spam|a letter|a reply] from {email}""",
    "phone": """[ring|text|phone|message|reach|buzz|call up] [me|us|him|her|my mum|the shop|grandpa] [on|at|under|via] {phone}
[my|his|her|our|dad's|the office] [phone|cell|mobile|new number|phone number|landline|whatsapp|telegram|contact number] [is|was|:|=|->|should be] {phone}
{phone} [is|was] [my|his|her|our|the] [cell|mobile|number|line|new number|work phone]
[in an emergency|if you get lost|when you land|for the ride|after work] [dial|call|ring|try] {phone}
[save|write down|note|keep|store] [my number|this number|it]: {phone}
[phone|tel|tel.|cell|mobile|mob|fax|handy|call|text|telefon|móvil|portable][:| |.] {phone}
[send|shoot] [me|us|her] a [text|whatsapp|sms|voice message] [at|on|to] {phone}
[rufen sie|ruft] [mich|uns|ihn] [an|mal an|bitte an|zurück] [unter|auf|:] {phone}
[meine|seine|ihre|unsere] [nummer|handynummer|telefonnummer|festnetznummer] [ist|lautet|war] {phone}
[llámame|llama|llámanos|márcame] [al|en el|a este número] {phone}
[mi|su|nuestro] [teléfono|móvil|número|celular|whatsapp] [es|era|:] {phone}
[appelle|rappelle|contacte] [moi|nous|le] [au|sur le] {phone}
[mon|son|notre] [numéro|portable|téléphone|tel] [c'est|est le|est|:] {phone}
[chiamami|chiama|scrivi] [al|sul] {phone}
[il mio|il suo] [numero|cellulare|telefono] è {phone}
[bel|app|sms] [me|ons|haar] [op|via] {phone}
[meu|o meu] [telefone|celular|número|zap] é {phone}
[they|she|someone|the bank] [called|texted] [me|us] [from|with] {phone}
[either|try] {phone} [or|and] {phone}""",
    "identity": """[his|her|mum's|our|the kid's] {idword} [is|was|reads|says|:|=|] {id}
my {idword} [reads|says|goes|was|=] {id}
[his|her|your] {idword} [number|no|no.|nr|#] [is|:|=|] {id}
{idword}[:| |: | - |# ]{id}
{id} [is|was] [my|his|her|the] {idword}
[they|the bank|the airline|the clerk|some site] [want|asked for|need|copied|leaked] [my|our|her] {idword} {id}
[i|we|she] [lost|found|renewed|typed|faxed] [my|the|her] {idword} {id} [today|again|last year]
[for the|in the] [form|visa|claim|contract|application] [put|use|enter|write] {idword} {id}
[meine|seine|ihre|die] {idword_de} [ist|lautet|war|:] {id}
[mi|su|nuestro|el] {idword_es} [es|era|:|número] {id}
[mon|son|ma|le|notre] {idword_fr} [est|c'est|:|numéro] {id}
[il mio|la mia|mijn|meu|o meu] {idword_more} [è|is|é|:] {id}
[i|we] [filed|sent] [taxes|the papers|the claim] under {idword} {id}
[holder|patient|applicant|for] {person}, {idword} {id}
[born|issued|valid] [in 1990|since may|until 2031], {idword} {id}
[here|fine|ok|look], {idword} [is|goes like|:] {id} [for you|so stop asking|i think]""",
    "address": """[we|they|my parents|my aunt|she] [live|stay|lived|rent a flat|grew up] [at|to|in|near] {address}
[our|my|her|the new|grandma's] [house|flat|place|home|office|apartment|street address] [is|was|stands] [at|on|] {address}
[the|our|their] [house|shop|clinic|school|bakery|garage] at {address} [is|was|looks] [white|closed|for sale|haunted|huge]
[ship|post|deliver|send|mail] [it|the parcel|the shirt|my prize|the cable] to {address}
[come|drive|walk|bike] [over to|to|by] {address} [tonight|at six|after lunch|on sunday]
[her|home|billing|postal|delivery] address[:| is| =|, ] {address}
[pick|collect|drop] [me|him|the kids|it] [up|off] [at|from|in front of] {address}
[the|our] [birthday|barbecue|lan party|meeting|wedding] [is|takes place|happens] at {address}
[ich|wir|sie] [wohne|wohnen|ziehen] [in der|am|im|nach|] {address}
[schick|liefere|bring] [es|das paket|die karte] [an|nach|in die] {address}
[vivo|vivimos|estoy] en {address}
[mi|nuestra|su] [dirección|casa] [es|está en|queda en] {address}
[j'habite|on habite|elle vit|rendez-vous] [au|à|] {address}
[mon|notre|son] [adresse|appart|domicile] [est|c'est|:] {address}
[abito|viviamo|ik woon|wij wonen|moro|bor] [in|op|na|på|] {address}
[the|a] [courier|pizza guy|taxi|ambulance] [went|came|drove] to {address} [twice|by mistake|already]
{person}[, | - |; ]{address}
{person}[, |; | / |: ]{address}[; |. | - |, phone |; mob. | / ]{phone}
[the invoice|a parcel|my card|the fine] [went|goes] to {address}[; | or |, ]{email}
{address} [is where|that's where] [i|we|my folks] [live|work|meet]""",
    "person": """[hi|hello|good evening], [i'm|i am|this is|it's|its|here is] {person} [from|of|out of] [uni|work|school|the club|next door|accounting]
[my|our|her|his] [dentist|doctor|teacher|boss|landlord|cousin|uncle|aunt|neighbour|coach|lawyer|roommate|classmate|brother|wife|son] [is|is called|was|,|named] {person}
{person} [wrote|painted|built|invented|prescribed|ordered|designed|fixed|wants|likes|knows|teaches|sold|signed] [it|this|the parser|that song|the bridge|maths|my bike|the papers] [yesterday|last week|for us|in march|]
[real name|full name|name|in real life i'm|irl i'm|legally i'm|born|née|signed|sincerely|yours|cheers][:| |, ] {person}
[his|her|their|my mum's] [real|full|actual|legal|given] name [is|was|would be] {person}
[ask|meet|thank|phone|email|invite|remember|google|follow] {person} [about it|on friday|for me|from the office|]
[i|we|she] [met|saw|know|married|hired|interviewed|miss|sued] {person} [at the station|in berlin|last summer|years ago|]
[yesterday|today|last night|on monday] {person} [called|died|visited|came by|got married|was here]
[greetings|regards|love|best wishes|hugs] [from|to] {person}
{person} [and|und|y|et|e|&] {person} [got married|are cousins|work here|wohnen hier|son amigos|sont là]
{person}'s [car|mother|dog|house|flat|team|wedding|phone] [broke|is here|was stolen|is great|barked]
{person} [hat|wird|war|kommt|wohnt] [gestern angerufen|morgen da sein|bei uns|das gebaut|hier]
[ich bin|mein name ist|mein lehrer heißt|er heißt|sie heißt|das ist|gezeichnet] [|||eigentlich|nämlich|jetzt|doch] {person}
[me llamo|mi nombre es|soy|se llama|él es|firmado] [|||en realidad|ahora] {person}
[je suis|mon nom est|il s'appelle|elle s'appelle|moi c'est|signé] {person}
[mi chiamo|sono|ik ben|mijn naam is|meu nome é|eu sou|jag heter|nazywam się] {person}
[contact|kontakt|customer|patient|author|tenant|passenger|witness][:| |: ] {person}
[paid|sent|booked|reserved|written|owned] by {person}
[a|the] [letter|package|message|gift] for {person} [arrived|is here|came back]
[ask for|speak to|call|reach|find] {person} [at|on|under|via] [{phone}|{email}]
{person} [from|of|in] [my|our|her] [school|street|office|choir|gym|village] [is here|joined|plays|left|reads this|knows]
[he|she|the guy|that girl|the new player|the admin|this one] [is|is called|is really|is actually] {person} [in real life|irl|offline|from my class|]
[my|our|her|his] [teacher|boss|sister|friend|cousin|coach|nurse|trainer] {person} [would|will|can|should|did] [come|help|laugh|agree|like it here|play too|never lie]
[team|group|pair|guests|seats|credits|cast][:| is|: me and| -] {person} [and|,|or] {person}
[my|our|her|his] [teacher|boss|sister|friend|cousin] {person}'s [brother|bike|laptop|plan|cooking] [made|paid for|saved] [it|the trip|us]
[the|our] [meeting|project|lesson|band|trial] with {person} [was|is] [fun|cancelled|at nine|long]
[tell|give|show|bring|hand|lend|send|pay] {person} [the news|we miss her|to call back|about the trip|i'm late|a hug|my notes|ten euros|regards from us|hello]
[me and|with|without|near|behind|like] {person} [at home|in class|on stage|since june|today]
[say|tell] [hi|hello|thanks] to {person} [for me|from us|please]""",
    "none": """{note} [why did they|we never|has he] {did} [my|our|the] {thing} [at|near|behind|under] {place}
[i|we|they] {did} {n} {thing} [and|but] {n} {thing} [near|from|at|inside] {place}
[can|could|will] [you|he|{note}] {do} [the|some|more|{n}] {thing} [please|today|for me|]
[selling|buying|trading|giving away|need|want] {n} {thing} [for|at] {n} [coins|emeralds|gold|credits] [each|total|]
[the|that|a] {beast} [dropped|guards|ate|has|hates|gave me] [the|{n}|my] {thing}
{beast} [spawns|hides|lives|attacks|sleeps] [at|near|behind|in] {place} [at night|now|again|]
[avoid|fight|feed|find|see|attack|thank|wake|praise] [the|that|] {beast} [and its {badge}|first|for {thing}|near {place}|again|so we get {thing}]
[our|the|new|best] [coords|coordinates|location|position|base|farm|portal] [are at|is at|:|at|=] {coords}
[meet|find|wait for|join] [me|us|them] [at|near|@] {coords} [or|in] [{n} minutes|nether|the cave]
[tp|teleport|warp|go|walk|fly] to {coords} [then|and] {do} the {thing}
[x|at] {c} [y|,|/] {y} [z|,|/] {c}
[seed|the seed|world seed|map seed] [is|was|:|=] {seed} [if you want it|enjoy|]
[ticket|case|order|claim|report|issue|bug|request|build|version|plot|lot|auction|quest|event|level|chunk|season] [#|no |number |nr ||id ]{n}[-{n}||-{big}|.{d}.{d}] [is|was|stays] [open|closed|lost|pending|broken|done]
[password|code|pin|combination|password hint] [of|for] the [vault|gate|chest] is {big}
[score|points|balance|bank|xp|money|record|high score] [is|:|was] {big} [now|again|]
[i|we] have {big} {thing} [and|in] {n} [chests|barrels|shulkers|double chests]
[ping|fps|tps|memory|uptime|queue position] [is|at|drops to] {n} [ms|again|]
[the|next] [event|race|war|season|restart|update] [starts|is|begins] [at {hh}|on {date}|in {n} minutes|{day} at {hh}]
[version|update|patch|release] {ver} [broke|fixed|changed] [the|my] {thing}
{badge} [is|was|drops|costs|sold for] [at|near|{n}|hidden in|] {place}
[i need|who sells|trade me|looking for] [the|a] {badge} [from|of|in] {place}
[i love|look at|welcome to|we left|best spot is|walk to|nothing beats|we rebuilt] {place} [at sunset|in winter|again|]
[{player}|{player} and {player}] {did} [my|our|all the] {thing}
[ask|thank|ban|kick|mute|follow|trust|invite|blame|contact|tell] {player} [about|for|near] the {thing}
[hey|hi|hello|thanks|sorry|good night|bye|wb|gz|welcome] {player}
[i'm|i am|this is|it's|my name here is|call me|known as] {player} [on this server|here|]
[this is|it's|i'm|i am] [the|a|just a|not a] [worst|best|silly|new|old] [server|player|builder|idea|day]
[my|our|her|his] [dentist|doctor|teacher|boss|landlord|cousin|uncle|neighbour|coach|brother|sister] [is|was|says] [strict|asleep|funny|a gamer|away|here|too loud]
/[msg|tell|w|r] {player} [hi|ok|where are you|nice {thing}|come to {place}|got {n} {thing}]
/[tpa|home|warp|sethome|spawn|back|rtp] [{coords}|{player}|base{d}|market|mine|]
/[clear|kit|pay|eco|sell|bid|ah] {player} [{n}|{big}|{thing} {n}]
/{cmd} [near {n}|inspect|page {n}|undo {n}|lookup r:{n} t:{n}[m|h] u:{player}|restore t:{n}d #preview u:{player}]
/[ban|mute|warn|kick|tempban] {player} [{n}d|{n}h|] [spam|griefing|caps|advertising] [case {n}-{big}|]
/[gamemode|time|weather|difficulty|fill|setblock|summon|locate|seed|title|say|vote|trust|claim|lock] [{n}|{coords}|{thing}|{big}|day|clear|@a|@e[[type={thing},limit={n}]]|]
[lol|ok|gg|brb|afk|haha|nice|thx|np|wow|nope|yes|hm|wtf|same|idk|true|cool] [lol|guys|that hurt|see you|later|one sec|me too|]
[does|did] [anyone|{note}] [know|see|remember] [how to {do} {thing}|where {place} is|what {n} means|who {did} it]
[why|how|when] [is|was] the {thing} [so|not] [slow|loud|broken|rare|cheap|bright]
[my|the] [dog|cat|horse|bed|roof|door|boat|internet|keyboard] [is gone|broke|needs food|is stuck|died again]
[i'm|we are|they were|she's] [building|mining|fishing|sleeping|eating|looking|hiding|waiting] [at|near|in] {place} [since|for] {n} [minutes|hours|days]
[i speak|he writes|please talk|sign in] {tongue} [only|and a bit of {tongue}|please|]
[see you|back|market opens|no raid|double xp] [on|next|every|this] {day}
[my email|my phone|my number|her passport|your address|my real name|the id card] [is|was] [secret|lost|none of your business|in my pocket|too long|private]
[send|give|tell] me your [email|number|phone|address|name|discord] [please|or else|first|]
[call|text|ring|mail] [me|him|us] [later|tomorrow|maybe|when done|after dinner|]
[i live|we stay|come over|my house is|send it] [near|next to|behind] {place}
[street|road|avenue|lane|row] {d} [is|needs|has] [flooded|more {thing}|lights|no doors]
[my|house|plot|shop] [number|nr] {n} [on|in|at] [the market|the main road|spawn street|the harbour road|west row]
[put|stack|place|lay] {n} [oak|stone|birch|brick|gravel] [road|street|lane|path] [blocks|tiles|lamps|signs]
[use|ping|ask] @[everyone|here|all|mods|builders] [only|for raids|if stuck]
[wer|hat jemand|kann jemand] [hat|mein|meine|das|bitte] {thing} [bei|an|hinter] {place} [gesehen|geklaut|gebaut]
[ich brauche|ich suche|verkaufe|wir haben] {n} {thing} [für|und|bei] [{n} münzen|{place}|danke]
[ich bin|wir sind|ich heiße nicht|ich wohne] [müde|gleich da|beim turm|bei {place}|umsonst da|raus]
[alguien|quién|necesito|vendo|tengo] [tiene|vio|quiere|por ahora|casi] {n} {thing} [por favor|en {place}|gracias|]
[soy|estoy|me llamo a] [nuevo aquí|perdido|silencio|en {place}|cansado]
[qui a|on a|il faut|je vends|je cherche] [pris|encore|deux|bien] {n} {thing} [à|vers|près de] {place}
[je suis|c'est|on est] [nouveau|perdu|en retard|à {place}|mort encore]
[map|wiki|guide|page|chapter|row|seat|bus|line|track|lap|round|wave|floor] {n} [has|needs|shows] [the {thing}|{n} {thing}|an error]
[i died|we lost|he fell] [to|against|near] {beast} [{n} times|with {n} {thing}|at {coords}|]
[ingame|server|faction|clan|guild] [rules|shop|bank|war] [{n}|at {place}|on {day}] [is|was] [fun|unfair|closed]
[red|blue|green] team [won|lost|leads] {n}[-|:| to ]{n} [in round {d}|again|]
[the price|rent|tax|fine|bounty] [went|goes|fell] [from|to] {big} [to {big}|coins|per day]
[thing|stuff] [from|at] {place} [and|or] {place} [is|was] [nicer|gone|far]
[the|a|every|no|each|that|one] [only|good|lone|new|poor|] {clan} [clan|guild|tribe|people|trader||] [is|was|needs|sells|likes|left] [{thing}|a {badge}|alone|at {place}|sleeping]
[the|all|some|those|many|these] {clan}s [are|were|have|want|left] [{thing}|late|at {place}|tired|{n} boats]
{clan} [and|or|vs|against] {clan} [at|in|near] {place} [now|on {day}|]
[el|la|un|una|mi|tu|este] {es} de {es} [está|es|fue|queda] [lejos|en {place}|muy {es}|aquí|cerca de {place}]
[eres|es|son|vamos|hay|busco|quiero] [un|una|la|el] {es} [de|con|sin|y] {es} [por favor|hoy|gracias|]
[du bist|das ist|wir sind|er ist|hier ist] [so|ein|eine|der|die|kein] {de} [und|mit|ohne|von] {de} [heute|hier|schon wieder|]
[le|la|un|une|mon|ton] {fr} de {fr} [est|était|reste] [loin|à {place}|ici|encore {fr}]
[il|la|un|una] {es} di {es} [è|era] [qui|lontano|grande]
[you|he|she|that guy|{player}|this admin] [are|is] [a|an|such a|no] [total|real|{rude}|silly|] {rude} [lol|again|and knows it|]
[gg|wb|ty|ez|rip|lol|oi|bye|kys|gl] {player}[!| again|]
[ask|look|wait|pay|apply|vote] for [{thing}|more {thing}|{beast}|{badge}][ at {place}|]
[stop it|shut it|get lost|go away|quit] [you|ya|] {rude}
[the] {Adj} {Badge} [is|was|,] [mine|overpriced|a myth|so rare|{n} coins]""",
}
#: openers and tails are harmless clauses beside a carrier
OPEN = """[hey|hi|yo|ok|well|so|oh|hm|listen|wait|psst|sorry|btw|fyi|guys|bro|mate|dude|please note|quick one|by the way|one more thing|also|and|look]
[hallo|na|übrigens|hola|oye|por cierto|salut|dis|au fait|ciao|hoi]""".splitlines()
TAIL = """[thanks|thx|ok|please|pls|bye|cheers|see you|cu|lol|haha|right|deal|don't share it|until friday|for real|no joke|just in case|in case you forgot|all day|before noon|got it|let me know|if needed|for the record]
[danke|bitte|gracias|vale|merci|stp|grazie|bedankt|obrigado]""".splitlines()
_IDWORD = "ssn|SSN|social security|social security number|passport|passport no|id card|ID|national id|national insurance|insurance number|health insurance|medicare|NHS|tax id|tax number|TIN|driver's license|driving licence|driver licence|licence|license|residence permit|visa number|aadhaar|PAN card|nino|voter id|green card|student id card|military id|birth certificate|pension number".split("|")
_IDWORD_DE = "ausweisnummer|personalausweis|reisepass|passnummer|steuernummer|steuer-id|sozialversicherungsnummer|versichertennummer|führerscheinnummer|krankenkassennummer".split("|")
_IDWORD_ES = "dni|nie|nif|pasaporte|curp|rfc|seguro social|número de afiliación|carné de conducir|cédula".split("|")
_IDWORD_FR = "numéro de sécu|sécurité sociale|carte d'identité|passeport|permis|numéro fiscal|carte vitale|permis de conduire".split("|")
_IDWORD_MORE = "codice fiscale|carta d'identità|passaporto|bsn|burgerservicenummer|rijbewijs|paspoort|cpf|rg|pesel|personnummer".split("|")


class _Filler:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def form(self, pattern: str) -> str:
        """d is a digit, A a capital letter, all else stands for itself."""
        return "".join(self.digits(1) if c == "d" else self.letters(1) if c == "A" else c for c in pattern)

    def family(self) -> str:
        r = self.r
        one = lambda: r.choice(_FAMILY).capitalize() if r.random() < 0.4 else (r.choice(_HEAD) + r.choice(_TAIL)).capitalize()
        x = r.random()
        if x < 0.08:
            return f"{one()}-{one()}"
        if x < 0.12:
            return r.choice(["O'", "Mc", "Mac", "D'"]) + one()
        return f"{r.choice(_PARTICLE)} {one()}" if x < 0.17 else one()

    def given(self) -> str:
        r = self.r
        x = r.random()
        return (r.choice(GIVEN) if x < 0.45 else r.choice(_GIVEN_MORE) if x < 0.7 else r.choice(_HEAD) + r.choice("a o e i is en ra el us ina ette an io ie ah".split())).capitalize()

    def person(self) -> str:
        r = self.r
        first, last = self.given(), self.family()
        x = r.random()
        s = f"{first} {last}" if x < 0.82 else f"{first} {self.letters(1)}. {last}" if x < 0.87 else f"{first} {self.given()} {last}" if x < 0.94 else f"{last.capitalize()} {first}"
        return self.cased(s, 0.3, 0.06)

    def cased(self, s: str, lower: float, upper: float) -> str:
        x = self.r.random()
        return s.lower() if x < lower else s.upper() if x < lower + upper else s

    def email(self) -> str:
        r = self.r
        g, f = self.given().lower(), self.family().lower().replace("-", "").replace(" ", "").replace("'", "")
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}{self.digits(2)}", f"{g}{1940 + r.randrange(75)}", f"{f}+{r.choice(_HOST)}", f"{g}{self.digits(2)}", f"{g}-{f}", f"{f}{self.digits(1)}", g, g, f, r.choice(_HOST), r.choice(_PLAYER_A) + r.choice(_PLAYER_B), f"{r.choice(_PLAYER_A)}.{r.choice(_PLAYER_B)}{self.digits(2)}", f"{g}{f}"])
        domain = f"{r.choice(_HOST) if r.random() < 0.6 else r.choice(_HEAD) + r.choice(_TAIL)}{r.choice(['', '', '-' + r.choice(_HOST), '.' + r.choice(_HOST)])}.{r.choice(_END)}"
        s = r.choice(["{0}@{1}"] * 6 + ["{0} @ {1}", "{0} at {2}", "{0} at {2}", "{0}[at]{3}", "{0} [at] {3}", "{0}(at){1}", "{0}(at){1}", "{0}(at){4}", "{0} (at) {4}", "{0} AT {5}", "{0}{{at}}{1}", "{0} at {1}"])
        s = s.format(local, domain, domain.replace(".", " dot "), domain.replace(".", " [dot] "), domain.replace(".", " (dot) "), domain.replace(".", " DOT "))
        return s.upper() if r.random() < 0.06 else s

    def phone(self) -> str:
        r = self.r
        s = self.form(r.choice([
            "ddd-ddd-dddd", "(ddd) ddd-dddd", "(ddd) ddd dddd", "(ddd)ddd-dddd", "ddd.ddd.dddd", "dddddddddd", "ddd ddd dddd", "+1 (ddd) ddd-dddd", "+1 ddd ddd dddd", "+1dddddddddd", "+1-ddd-ddd-dddd", "1-ddd-ddd-dddd", "ddd-dddd", "ddd/ddd-dddd",
            "07ddd dddddd", "07ddd-dddddd", "07ddd ddd ddd", "07ddddddddd", "020 dddd dddd", "0ddd ddd dddd", "+44 7ddd dddddd", "0044 7ddd dddddd", "+44 (0)7ddd dddddd", "+447ddddddddd", "(0ddd) ddd dddd",
            "+49 (0)30 ddddd ddd", "+49 30 dddddddd", "030 ddddd ddd", "030/dddddddd", "0ddd ddddddd", "0ddd-ddddddd", "01ddd dddddddd", "+49 1dd ddddddd", "089 ddd ddd", "01dd/ddddddd", "+43 d ddd dd dd", "+41 dd ddd dd dd", "0dd ddd dd dd",
            "+33 d dd dd dd dd", "0d dd dd dd dd", "0d.dd.dd.dd.dd", "0d-dd-dd-dd-dd", "+33ddddddddd", "+34 ddd ddd ddd", "6dd ddd ddd", "6dd dd dd dd", "+34 6dd dd dd dd", "+39 3dd ddd dddd", "3dd dddddd", "06 dddd dddd", "+31 6 dddd dddd", "06-dddddddd",
            "+61 4dd ddd ddd", "04dd ddd ddd", "+91 ddddd ddddd", "+55 dd ddddd-dddd", "(dd) ddddd-dddd", "+52 dd dddd dddd", "+81 dd-dddd-dddd", "0dd-dddd-dddd", "+86 ddd dddd dddd", "+46 7d-ddd dd dd", "07d-ddd dd dd", "+48 ddd ddd ddd", "+353 dd ddd dddd", "+234 ddd ddd dddd",
        ]))
        if r.random() < 0.08:
            cut = r.choice([3, 4])
            s = s[:-cut] + " " + " ".join(_DIGIT[int(x)] for x in self.digits(cut)) if s[-cut:].isdigit() and s[-cut - 1] in " -." else s
        return s

    def id(self) -> str:
        return self.form(self.r.choice([
            "ddd-dd-dddd", "ddd dd dddd", "9dd-dd-dddd", "ddddddddd", "Addddddddd"[:9], "AAddddddd", "Adddddddd", "AAAdddddd", "AdddddddA", "ddAAddddd", "AA dddddd A", "AA dd dd dd A", "AAddddddA", "ddd ddd dddd", "dddd dddd dddd", "AAAAAddddA", "ddddddddA", "dddddddd-A", "Addddddd-A", "dddd-ddd-dd-A",
            "dd ddd ddd ddd", "ddd/ddd/ddddd", "ddddddddddd", "dd-ddddddd", "ddd ddd ddd", "d dd dd dd ddd ddd dd", "ddddddddddddddd", "AAAAAAddAddAdddA", "ddd.ddd.ddd-dd", "dddddd-dddd", "dddddd/dddd", "ddddddddd AA", "756.dddd.dddd.dd", "dddd ddddd d", "A-dddd-dddd-dd", "AddddAAdd", "AddAdddddd"[:8], "AddA ddddd", "dd.dd.dd-ddd.dd", "DEddddddddd", "AAddddddAddddd", "Addd-dddd-dddd", "AA-ddddddd", "d-dddd-ddddd-dd-d", "Ldd-ddd-ddd", "ddddd-dddddd", "AAdddddddddA", "dd dddddd A ddd",
        ]))

    def address(self) -> str:
        r, d = self.r, lambda n: str(r.randrange(1, n))
        x = r.random()
        if x < 0.52:
            middle = " ".join(r.sample(_STREET, r.choice([1, 1, 1, 2]))) + (" " + r.choice(LANDFORMS).capitalize() if r.random() < 0.25 else "") if r.random() < 0.7 else (r.choice(_HEAD) + r.choice(_TAIL)).capitalize() + r.choice(["", "", "'s"])
            middle = f"{r.choice(['1st', '2nd', '3rd', '5th', '7th', '12th', '42nd'])}" if r.random() < 0.05 else middle
            s = f"{d(2000)}{r.choice(['', '', '', 'a', 'b', 'B'])} {r.choice(['', '', '', '', 'N ', 'S. ', 'West ', 'Old ', 'Upper '])}{middle} {r.choice(_STREET_KIND)}"
            y = r.random()
            s = f"{r.choice(['Flat', 'Apt', 'Unit', 'Suite'])} {d(60)}{r.choice(['', 'A'])}, {s}" if y < 0.1 else s + f"{r.choice([',', ''])} {r.choice(['apt', 'apt.', 'flat', 'unit', '#'])} {d(60)}" if y < 0.22 else s
            s += r.choice(["", "", f", {r.choice(_TOWN)}", f", {r.choice(_TOWN)} {self.digits(5)}", f", {r.choice(_TOWN)}, {r.choice(_COUNTRY)}", f", {self.letters(2)}{d(20)} {d(9)}{self.letters(2)}", f" in {r.choice(_TOWN)}"])
        elif x < 0.72:
            s = r.choice([f"{r.choice(_GERMAN)}{r.choice(_GERMAN_KIND)}", f"{(r.choice(_HEAD) + r.choice(_TAIL)).capitalize()}{r.choice(_GERMAN_KIND)}", f"{r.choice(['Am', 'An der', 'Im', 'Zum', 'Alte', 'Lange'])} {r.choice(_GERMAN)}{r.choice(['hof', 'berg', 'tor', 'feld', 'bach', 'gasse', 'straße'])}", f"{r.choice(_NORTH)}{r.choice(_NORTH_KIND)}", f"{r.choice(_GERMAN)}er {r.choice(['Straße', 'Weg', 'Platz', 'Allee'])}"])
            s += f" {d(160)}{r.choice(['', '', '', 'a', ' B'])}" + r.choice(["", "", f", {self.digits(5)} {r.choice(_TOWN)}", f" in {r.choice(_TOWN)}", f", {self.digits(4)} {self.letters(2)} {r.choice(_TOWN)}"])
        else:
            road = f"{r.choice(_LATIN)} {r.choice(_LATIN_NAME)}"
            road = road.capitalize() if r.random() < 0.4 else road
            s = r.choice([f"{d(150)}{r.choice(['', '', ' bis', ','])} {road}", f"{road}{r.choice([' ', ', ', ' n ', ' nº '])}{d(150)}"]) + r.choice(["", "", f", {self.digits(5)} {r.choice(_TOWN)}", f", {r.choice(_TOWN)}", f", {d(9)}º {self.letters(1)}"])
        return self.cased(s, 0.28, 0.04)

    def player(self) -> str:
        r = self.r
        a, b = r.choice(_PLAYER_A), r.choice(_PLAYER_B)
        c, e = a.capitalize(), b.capitalize()
        return r.choice([f"{c}_{e}{self.digits(r.randrange(5))}", f"{c}{e}{self.digits(r.randrange(6))}", f"x{c}{e}x", f"xX_{c}{e}_Xx", f"{e}Of{c}{self.digits(3)}", f"{a}_{b}_{self.digits(4)}", f"{a}{b}{self.digits(3)}", f"{c[:3]}{e[:3]}{self.digits(5)}", f"The{c}{e}", f"{e}{self.digits(4)}", f"_{a}{b}_", f"i{c}{e}", f"{r.choice(_GIVEN_MORE)}{self.digits(3)}", f"{r.choice(GIVEN).capitalize()}_{e}{self.digits(2)}", f"Mr{e}", f"{c}_{e}_{self.digits(2)}"])

    def plain(self, slot: str) -> str:
        r = self.r
        c = lambda: str(r.choice([1, -1, 1]) * r.randrange(10 ** r.choice([1, 2, 3, 3, 4, 4])))
        y = lambda: str(r.randrange(-60, 320))
        proper = lambda s: s.title() if r.random() < 0.6 else s
        made = lambda: (r.choice(_HEAD) + r.choice(_TAIL)).capitalize()
        return {
            "thing": lambda: r.choice(_THING) if r.random() < 0.8 else f"{r.choice(_ADJECTIVE)} {r.choice(_THING)}",
            "did": lambda: r.choice(_DID), "do": lambda: r.choice(_DO), "note": lambda: r.choice(_NOTE),
            "place": lambda: r.choice([f"{r.choice(_ADJECTIVE)} {r.choice(LANDFORMS)}".title(), f"the {r.choice(_ADJECTIVE)} {r.choice(LANDFORMS)}", f"the {r.choice(LANDFORMS)}", f"{r.choice(_ADJECTIVE)} {r.choice(LANDFORMS)}", f"{made()} {r.choice(LANDFORMS).capitalize()}", f"{r.choice(CREATURES)}'s {r.choice(LANDFORMS)}".title().replace("'S", "'s"), "spawn", "my base", f"{r.choice(LANDFORMS)} of the {r.choice(CREATURES)}"]),
            "beast": lambda: proper(f"{r.choice(_ADJECTIVE)} {r.choice(CREATURES)}") if r.random() < 0.75 else r.choice(CREATURES),
            "badge": lambda: f"{r.choice(_ADJECTIVE).title()} {r.choice(_BADGE)}", "Adj": lambda: r.choice(_ADJECTIVE).title(), "Badge": lambda: r.choice(_BADGE),
            "coords": lambda: r.choice(["{0} {1} {2}", "{0}, {1}, {2}", "{0} / {1} / {2}", "{0} {2}", "{0}/{1}/{2}", "({0}, {1}, {2})", "x{0} z{2}", "{0},{1},{2}"]).format(c(), y(), c()),
            "c": c, "y": y, "n": lambda: str(r.randrange(1, 10 ** r.choice([1, 2, 2, 3]))), "d": lambda: str(r.randrange(1, 10)),
            "big": lambda: str(r.randrange(10 ** r.choice([3, 4, 5, 5]))), "seed": lambda: r.choice(["", "-"]) + str(r.randrange(10 ** r.choice([6, 9, 10, 12, 16, 18, 19]))),
            "hh": lambda: f"{r.randrange(24)}:{r.randrange(10, 60)}", "ver": lambda: f"1.{r.randrange(22)}.{r.randrange(9)}", "date": lambda: r.choice([f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.2022", f"2022-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", f"{r.randrange(1, 13)}/{r.randrange(1, 29)}", f"{r.choice(_DAY)} {r.randrange(1, 29)}"]),
            "clan": lambda: made() if r.random() < 0.5 else f"{made()}{r.choice(['i', 'an', 'ish', 'ari', 'ese', 'ian'])}",
            "rude": lambda: r.choice("idiot moron bastard loser jerk clown fool dumbass scumbag creep worthless pathetic useless rotten annoying trottel idioten payaso tonto crétin noob trash liar cheater stupid lazy".split()),
            "es": lambda: r.choice("casa torre puerta mina granja caballo espada piedra hierro madera agua oro libro cama mesa pan barco isla cueva noche mapa camino amigo jefe perro gato tonto pueblo montaña río".split()),
            "de": lambda: r.choice("Haus Turm Tor Mine Farm Pferd Schwert Stein Eisen Holz Wasser Gold Buch Bett Tisch Brot Boot Insel Höhle Nacht Karte Weg Freund Chef Hund Katze müde fertig froh lieb schnell".split()),
            "fr": lambda: r.choice("maison tour porte mine ferme cheval épée pierre fer bois eau or livre lit table pain bateau île grotte nuit carte chemin ami chef chien chat vide perdu".split()),
            "day": lambda: self.cased(r.choice(_DAY).capitalize(), 0.5, 0.0), "tongue": lambda: self.cased(r.choice(_TONGUE).capitalize(), 0.5, 0.0),
            "cmd": lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.choice([1, 2, 2, 3]))), "player": self.player,
            "idword": lambda: self.cased(r.choice(_IDWORD), 0.3, 0.1), "idword_de": lambda: self.cased(r.choice(_IDWORD_DE).capitalize(), 0.4, 0.0), "idword_es": lambda: self.cased(r.choice(_IDWORD_ES), 0.4, 0.3), "idword_fr": lambda: r.choice(_IDWORD_FR), "idword_more": lambda: self.cased(r.choice(_IDWORD_MORE), 0.4, 0.2),
        }[slot]()


_CHOICE = re.compile(r"\[([^\[\]]*)\]")
_SLOT = re.compile(r"\{([a-zA-Z_0-9]+)\}")


def expand(rule: str, r: random.Random) -> str:
    """One choice of all alternatives of a rule, inner ones first; [[ and ]] stand for brackets."""
    text = rule.replace("[[", "\x01").replace("]]", "\x02")
    while _CHOICE.search(text):
        text = _CHOICE.sub(lambda m: r.choice(m[1].split("|")), text)
    return " ".join(text.replace("\x01", "[").replace("\x02", "]").split())


def fill(frame: str, f: _Filler) -> list[tuple[str, str]]:
    """Stretches of text with their kind ('' for none)."""
    out, at = [], 0
    for m in _SLOT.finditer(frame):
        slot = m[1]
        out.append((frame[at : m.start()], ""))
        if slot == "person" and f.r.random() < 0.06:
            out.append((f.r.choice(_TITLE).capitalize() + " ", ""))
        out.append((getattr(f, slot)(), "identity" if slot == "id" else slot) if slot in KINDS or slot == "id" else (f.plain(slot), ""))
        at = m.end()
    return [x for x in [*out, (frame[at:], "")] if x[0]]


def rules(kind: str, part: int | None = None, parts: int = 4, inside: bool = True) -> list[str]:
    """Rules of a kind: all, or those in (or not in) one of ``parts`` parts."""
    found = RULES[kind].splitlines()
    return found if part is None else [x for k, x in enumerate(found) if (k % parts == part) == inside]


_LIKE = str.maketrans("aeopcxi", "аеорсхі")  # Cyrillic letters that look like Latin ones


def noisy(row: list[tuple[str, str]], r: random.Random) -> list[tuple[str, str]]:
    """Harmless words of a row stretched, mistyped, or written in look-alike letters."""
    out = []
    for s, kind in row:
        words = s.split(" ")
        for k, w in enumerate(words):
            if not kind and len(w) > 3 and w.isalpha() and r.random() < 0.4:
                i = r.randrange(1, len(w) - 1)
                words[k] = r.choice([w[:i] + w[i] * r.randrange(3, 7) + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + r.choice("abdeginqrst") + w[i:], w.translate(_LIKE)])
        out.append((" ".join(words), kind))
    return out


def labelled_table(seed: int = 7, positive: int = 450, negative: int = 2200, part: int | None = None, inside: bool = True) -> list[list[tuple[str, str]]]:
    """``positive`` rows of each kind and ``negative`` harmless ones: carriers, alone or beside other clauses, cased in several ways."""
    f = _Filler(seed)
    r = f.r
    harmless = rules("none", part, inside=inside)
    carriers = [(rules(k, part, inside=inside), positive if k != "person" else 2 * positive) for k in KINDS] + [(harmless, negative)]
    rows = []
    for found, n in carriers:
        for k in range(n):
            row = fill(expand(found[k % len(found)], r), f)
            if r.random() < (0.12 if found is harmless else 0.04):
                row = noisy(row, r)
            x = r.random()
            if x < 0.25:
                row = [(expand(r.choice(OPEN), r) + r.choice([" ", ", ", ": "]), ""), *row]
            if r.random() < 0.25:
                row = [*row, (r.choice([" ", ", ", " - ", ". "]) + expand(r.choice(TAIL), r), "")]
            x = r.random()
            if x < 0.35:
                other = fill(expand(r.choice(harmless), r), f)
                gap = (r.choice([". ", "; ", ", ", " - ", " / ", "\n", " ", "! ", "? ", " | "]), "")
                row = [*row, gap, *other] if x < 0.18 else [*other, gap, *row]
            if r.random() < 0.2:
                row = [*row, (r.choice([".", "!", "?", "!!", " :)", "..."]), "")]
            x = r.random()
            if x < 0.13 and not row[0][0].startswith("/"):
                row = [(r.choice(["/msg {p} ", "/tell {p} ", "/w {p} ", "/mail send {p} ", "/r ", "/reply ", "/me ", "/ticket new ", "/helpop ", "/say "]).replace("{p}", f.player()), ""), *row]
            elif x < 0.2:
                row = [(s.upper(), k) for s, k in row]
            elif x < 0.26:
                row = [(s.title() if not k else s, k) for s, k in row]
            elif x < 0.4:
                row = [(row[0][0][:1].upper() + row[0][0][1:], row[0][1]), *row[1:]]
            rows.append(row)
    return rows
