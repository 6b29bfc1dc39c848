"""Sentences written by hand before the model was run on them: kinds (e mail, p hone, i dentity, a ddress, n ame; - none) and text."""

SENTENCES = [line.split("|", 1) for line in """n|Rudolf Steinmetz hat gestern angerufen
n|Kwame Mensah wrote the parser yesterday
n|Dr. Amina Yusuf prescribed it
n|our dentist is Nguyen Thi Minh
n|/mail send Steve hey its Olu Adeyemi from uni
a|the house at 1600 Pennsylvania Avenue is white
i|aadhaar 4991 1866 5246
i|my NHS number is 943 476 5919
e|you'll get the receipt if you write to billing.desk@northwind.co.uk
e|ping marta_kowal@poczta.pl about the rent
e|my uni mail: t.okonkwo@students.unilag.edu
e|lost access to gamerdad77@hotmail.com, dont use it
e|h.lindgren at kth dot se, that's his address
e|use sales[at]bricks-and-co[dot]com for bulk orders
e|send the cv to jobs@kleinwerk.de until monday
e|mein neues postfach ist anke.brandt@web.de
e|escríbele a lucia.ferrer@correo.es si tienes dudas
e|le mail du prof c'est p.marchand@ac-lyon.fr
e|puoi scrivere a info@trattoria-lina.it
e|pls forward this to my landlord: rkhan@lettings.com
e|i subscribed with dana.whitlock+news@gmail.com and got nothing
e|anything weird goes to abuse@hostbox.net
e|/msg Elk_Rider hit me up: zoe.tan@yahoo.com.sg
e|registered as petrovich@mail.ru, password forgotten
e|reach the council under office(at)dunmore.ie
e|she still reads old.account1999@aol.com sometimes
e|CC KAREN.BLAKE@FIRMA.COM ON THAT
e|o convite foi para joao.prado@uol.com.br
p|if the car breaks down ring 0161 496 0345
p|dad's landline is (212) 555-0188
p|meine handynummer lautet 0171 5550123
p|llámame al 612 34 56 78 cuando llegues
p|mon portable c'est le 06 12 34 56 78
p|new sim, save 07911 123456
p|text 303-555-0142 for pizza
p|whatsapp +55 11 91234-5678
p|the clinic's fax: 020 7946 0991
p|you can dial +1 415 555 2671 any time
p|chiamami al 347 123 4567
p|/tell Fox22 my cell 6175550133
p|bel me op 06-12345678
p|hotline +49 30 901820 is busy
p|her number changed to 0412 345 678
p|ring mum 01632 960 983 please
p|tel. 089 1234567, ask for the manager
p|+91 98765 43210 is my work phone
p|sms an 0176/5551234 reicht
p|call us: 1-800-555-0199
p|reach grandma on 028 9018 0123
p|zadzwoń 601 234 567, mobile
i|passport X1234567 expires in march
i|mi DNI es 12345678Z
i|social security 078-05-1120 is on the card
i|her driving licence is MORGA753116SM9IJ
i|numéro de sécu 1 84 12 76 451 089 46
i|meine Steuer-ID ist 86 095 742 719
i|the insurance no. QQ 12 34 56 C got rejected
i|cpf 529.982.247-25 for the receipt
i|personnummer 811218-9876, don't share
i|they scanned my id card L01X00T47
i|tax file number 123 456 782 was in the mail
i|il mio codice fiscale è RSSMRA85T10A562S
i|BSN 111222333 staat op je paspoort
i|green card A012345678 came today
i|PAN ABCDE1234F on the form
i|my TIN is 912-34-5678
i|medicare 2123 45670 1 for the doctor
i|pasaporte AAB123456 perdido en madrid
i|Ausweisnummer T22000129 steht hinten drauf
i|for the visa: passport no 533380006
i|EIN 12-3456789 of our company
a|we live at 221B Baker Street
a|ship it to 48 Oakridge Drive, Springfield
a|meine oma wohnt in der Lindenallee 14, 50667 Köln
a|vivo en calle de Atocha 27, Madrid
a|j'habite 12 rue de la Paix, 75002 Paris
a|via Garibaldi 8, terzo piano
a|the party is at 9 Elm Ct, bring snacks
a|taxi to 350 Fifth Avenue please
a|parcel left at 17 Church Lane again
a|new flat: Keizersgracht 101, 1015 Amsterdam; old one was Kerkstraat 5
a|her clinic moved to 2100 N Lincoln Ave
a|Am Markt 3, 99084 Erfurt is closed on mondays
a|pick me up from 6 Willow Close
a|rua Augusta 1500, são paulo
a|come by 77 Harbour Road around eight
a|Storgatan 12 in Umeå is where i grew up
a|send flowers to flat 4, 63 Queens Gardens
a|mailbox of 5 kingsway terrace is full
a|wir ziehen in die Goethestraße 22
a|the bakery at 118 Main St burned down
n|my landlord Tobias Krüger wants the rent
n|i sat next to Fatima Al-Sayed in chemistry
n|Ingrid Solberg taught me to ski
n|happy birthday to Mateo Fernández!
n|the lawyer, Rebecca Stone, never answered
n|Yuki Tanaka drew our banner
n|me llamo Carmen Ortiz, encantada
n|je m'appelle Bastien Lefort
n|mein chef heißt Jürgen Walter
n|has anybody seen Liam O'Connor today
n|my cousin Aisha Bello got a scholarship
n|signed, Gregory Hallam
n|it was Chen Wei who fixed my pc
n|mi chiamo Alessia Conti
n|nurse Dorothy Pike said rest
n|coach Andriy Shevchuk cancelled practice
n|thanks to Sven Åkerlund for the ride
n|irl i'm hannah mcbride btw
n|this account belongs to Priyanka Desai
n|zoltan kovacs from my street plays too
n|Mrs Eleanor Whitby reported it
n|Pieter van den Berg owns the bike shop
n|/w Moss_9 did Camila Rojas call you
n|our neighbour Wanjiru Kamau has a goat
an|Helena Brook, 31 Station Road
np|ask for Omar Siddiqui at 0113 496 0777
ne|Nora Lindqvist: nora.lindqvist@post.se
ap|8 Mill Lane, phone 01223 496 012
ep|mail leo@kite.io or call 415-555-0110
in|patient Karl Ziegler, insurance number A123456789
-|who stole my carrots from the barn
-|selling 64 oak logs for 3 emeralds each
-|my base is at 1200 70 -450
-|the Frost Giant dropped two shards
-|Silver Harbor looks great at night
-|ticket 4412 was closed by a mod
-|seed 8349201734 has a village at spawn
-|patch 1.19.4 crashed my game
-|Amber_Wolf21 killed my horse
-|tp me to Rusty_Otter please
-|double xp starts friday at 20:00
-|we need 3 more healers for the raid
-|the Crimson Keep is too hard
-|i have 12000 coins and nothing to buy
-|/home farm
-|/pay Blue_Fox 250
-|auction 77 ends in 5 minutes
-|does the Iron Golem guard the gate
-|Welcome to the server!
-|Good Morning Everyone
-|THE WITHER IS LOOSE RUN
-|row 4, column 7 is lava
-|meet at the Old Lighthouse in ten minutes
-|my ping is 240 again
-|ich suche noch 20 Eisenbarren
-|wo ist der Ausgang der Höhle
-|vendo tres espadas por 100 monedas
-|on construit un pont près du village
-|happy new year from the build team
-|chunk 15 -22 keeps resetting
-|the password for the vault is hidden in a book
-|what's your phone number lol
-|i won't tell you my real name
-|my teacher says games are bad
-|lost my id card at the arena
-|the road to Sunken Temple is blocked
-|build a street with 30 lamps
-|house 12 in the market is free
-|the answer is 42
-|Red Team beat Blue Team 5-3
-|Dragon Lair, bring fire potions
-|Monday is patch day
-|he speaks German and French
-|trading a Golden Compass for a Ruby Crown
-|Mossy Cobblestone Stairs look nice
-|Lord Voidwalker owns this castle
-|/ban Toxic_Panda 7d griefing
-|/lookup u:Shy_Newt t:3d r:20
-|our clan needs builders from Europe
-|the Great Hall was rebuilt in 2019
-|page 118 of the guide is wrong
-|level 30 enchant costs 3 lapis
-|use @here only in emergencies
-|that was 100% luck
-|lag spike at 18:45, 3 tps
-|y 11 is best for diamonds
-|x -3300 z 870, the shulker farm
-|/tpa Fuzzy_Lynx
-|every creeper blew up at once
-|the queen bee lives in Honey Grove
-|nether portal at 150 64 -37 links wrong
-|stop spamming caps
-|nice skin bro
-|server restarts in 15 min
-|i'm so tired today
-|this is the worst lag ever
-|Winter Event ends on 6 January
-|version 2.0 of the map is out
-|you got 1500 xp for that?
-|my dog ate my controller
-|the Storm Titan has 20000 hp
-|Build Contest rules are at spawn
-|anyone up for bed wars
-|claim 3081 borders mine
-|invite code for the guild is in the sign
-|Emerald Isle, dock 3
-|ask the blacksmith for a saddle
-|hast du meine Spitzhacke gesehen
-|mi casa está cerca del río
-|le boss du donjon est trop fort
-|there are 14 wolves near the bridge
-|Sapphire Lake froze over
-|bring 2 stacks of torches
-|keep right on the ice road
-|we lost 2-1 in the final""".splitlines()]
KIND = {"e": "email", "p": "phone", "i": "identity", "a": "address", "n": "person"}
