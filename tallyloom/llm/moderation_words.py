"""Word lists and seed sentences that the moderation network reads beside the labelled samples.

The lists give a word's input flags, they decide nothing alone: the same words stand in neutral sentences below.
"""

#: Stems by flag; a word carries the flag if, without disguise and without a leading Hebrew particle, it starts with one.
ABUSE = """
מניאק שרמוטה זונה דביל מטומטם מפגר חלאה טינופת נבלה אידיוט חרא אפס עלוב מסריח מנוול טמבל סתומה בהמה טיפש אשפה זבל כלב סתום שתמות תמות לירוק שתיחנק
idiot moron bastard asshole scum bitch whore retard loser dumb stupid fuck shit cunt prick dickhead trash garbage pathetic worthless choke rot
connard connasse salope putain merde imbécile crétin abruti débile ordure gueule crève enculé bâtard
урод идиот мразь тварь сдохни ублюд заткнись тупой конченый дебил сволоч подонок гнида кретин дура
كلب حمار غبي أحمق حقير وسخ قذر خنزير اخرس لعنة عاهرة تافه حيوان
""".split()
HATE = """
ג'וק גוק תת-אדם תתאדם טפיל מזוהם גנבים אנסים להשמיד להעיף תעיפו לגרש לשרוף לחסל חיסלו לכרות סרטן מחבלים חולירע נחותים שרצים עכברושים
vermin subhuman parasite cockroach wiped exterminate deport burn rats plague inferior savages filth back
vermine parasites cafards expulser exterminer brûler sous-hommes rats
паразит тараканы недочеловек истребить выгнать сжечь крысы уничтожить
حشرات طفيليات جرذان إبادة حرق اطردوا
""".split()
SEX = """
פורנו סקס זיונ אורגי חרמנ ערומ עירומ לוהט רטובות אוראלי חזיי שדיים ציצי גמיר מזדיינ סוטה ליווי צנזורה נאנח
porn xxx sex nude naked horny hardcore orgy gangbang strip moan bra wet blowjob cum tits oral escort fetish censorship
porno nue salopes baise chaude seins sexe
порно секс голая голые шлюх трах сиськи эротик
سكس إباحي عارية جنس عاريات
""".split()

#: Seed sentences by label, for languages and wordings that the samples lack.
SEEDS = {
    "abusive": """
כמה טיפש אפשר להיות, עוף לי מהעיניים יא אפס
הכותב הזה סתם בהמה, שייחנק כבר
איזה נבלה אתה, סתום את הפה
שתמותי כבר, שרמוטה מסריחה
הבן זונה הזה לא שווה כלום, בא לי להרביץ לו
אידיוט שכמוך, מקווה שתיפגע ותסבול
תראו את החרא הזה, כלב מסריח
היא זבל של בן אדם ותישאר זבל
יא מפגר, מגיע לך למות
הכתב הזה דביל מוחלט, שיפטרו אותו ושירעב
ליאת מורן היא אפס ותמיד תהיה אפס
you worthless piece of trash, go to hell
i hope you die, bastard
quel crétin, va crever
tu es une ordure, tout le monde te déteste
ce journaliste est un abruti, qu'il crève
какая ты тварь, чтоб ты сдох
ты дебил и подонок, тебя никто не любит
اخرس يا كلب يا حقير
أنت غبي وحمار، ليتك تموت
هذا الصحفي وسخ وتافه، لعنة عليه
""",
    "hateful": """
הם לא בני אדם, צריך לחסל את כולם
חבל שלא השמידו את כל השבט הזה עד האחרון
העדה הזאת היא סרטן שצריך לעקור מהארץ
כל המהגרים האלה חיות, לזרוק אותם לים
אסור לתת להם לחיות לידינו, הם טפילים מזוהמים
שרצים כאלה צריך לגרש ולשרוף להם את הכפר
they are a cancer on this country and must be cut out
it is a pity they were not all killed
those people are rats, throw them into the sea
their blood is filthy, never marry one of them
ces gens sont de la vermine, il faut les exterminer
эти люди паразиты, их надо истребить
выгнать их всех и сжечь их дома
هؤلاء حشرات يجب إبادتهم
اطردوهم جميعا واحرقوا بيوتهم
""",
    "sexual": """
צפו עכשיו בסרטי זיונים קשים עם בחורות רטובות
היא התפשטה לגמרי ונאנחה כשהוא נכנס בה
נערות ליווי לוהטות מחכות לשיחה שלך
גמר לה על השדיים והיא ביקשה עוד
וידאו אורגיות בלי צנזורה, כניסה מגיל שמונה עשרה
watch uncensored orgy clips with wet girls tonight
she stripped naked and moaned while he took her
live porn cams, horny teens over eighteen
vidéos porno gratuites, filles chaudes toutes nues
elle a enlevé son soutien-gorge et a gémi toute la nuit
смотри порно бесплатно, голые девушки ждут тебя
горячий секс сегодня ночью, звони сейчас
فيديوهات سكس مجانية وبنات عاريات بانتظارك
""",
    "clean": """
המשטרה עצרה חשוד שכתב ברשת איומים נגד עיתונאי
בית הדין דן בתביעת לשון הרע על המילה אידיוט
הסדנה עוסקת בחינוך מיני ובמניעת הטרדות
הווטרינר טיפל בכלבה ובגורים שלה
עובדי הניקיון פינו את הזבל והאשפה מהשוק
שריפה פרצה במטבח והדיירים פונו
התערוכה מציגה ציורי עירום מן הרנסנס
המחקר על סרטן הריאות פורסם החודש
הורים מחו נגד דברי הסתה וגזענות בבית הספר
מדביר ריסס נגד ג'וקים במחסן
הרשות תגרש חתולי רחוב מהמתחם לא כך אמר דובר העירייה
אחראי המשמרת בדק את התרופה
היא אמרה שהאישום באונס נדון בדלתיים סגורות
the kennel's dogs were vaccinated, including a bitch and her puppies
pest control removed rats and cockroaches from the kitchen
the court heard a case of sexual harassment
police arrested a man who posted threats against a minority
garbage trucks will collect the trash on tuesday
the union demands that dumb rules be scrapped, said the spokesman
doctors report that lung cancer is found earlier
le musée expose des nus de la renaissance
l'équipe de nettoyage a ramassé les ordures
la police enquête sur des menaces contre une journaliste
по данным комиссии, жители поддержали перемены
врачи раньше находят рак груди
музей показал картину с обнажённой моделью
وأفادت اللجنة بأن السكان رحبوا بالتغيير
تم تطعيم الكلب في العيادة البيطرية
""",
}
