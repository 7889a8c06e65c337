"""Small public word lists that several text operators use."""

from __future__ import annotations

# Common given names and their everyday short forms.
GIVEN_NAMES: dict[str, str] = {
    "alexander": "alex alec sandy sasha xander", "alexandra": "alex sasha sandra lexi", "andrew": "andy drew", "andres": "andi", "anneliese": "anne liesl", "anthony": "tony",
    "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy kate cat", "charles": "charlie chuck", "christina": "chris tina", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dmitri": "dima mitya", "donald": "don", "dorothy": "dot dottie", "edward": "ed eddie ted ned",
    "edwina": "edie winnie", "eleanor": "ellie nell nora", "elizabeth": "liz beth lizzie betty eliza", "eugene": "gene", "frances": "fran", "francisco": "paco", "frederick": "fred freddie",
    "genevieve": "gen genny viv", "gerald": "gerry", "gregory": "greg", "harold": "harry hal", "haruka": "haru", "helen": "nell", "henry": "hank harry", "ingrid": "inga", "isabella": "bella izzy",
    "jacob": "jake", "james": "jim jimmy", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "jo josie", "judith": "judy",
    "katherine": "kate kathy katie kat", "kenneth": "ken", "lawrence": "larry", "leonard": "len lenny leo", "margaret": "maggie meg peg peggy", "maria": "mia", "matthew": "matt", "michael": "mike mick mickey",
    "mireille": "mimi", "natalia": "natasha", "nathaniel": "nate", "nicholas": "nick nicky", "oliver": "ollie", "oluwaseun": "seun", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "priya": "pri", "rafael": "rafa raf", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby robbie", "ronald": "ron",
    "samantha": "sam", "samuel": "sam sammy", "sophia": "sophie", "stephen": "steve", "steven": "steve", "susanna": "sue susie", "susan": "sue", "theodore": "ted theo teddy", "theresa": "tess",
    "thomas": "tom tommy", "timothy": "tim timmy", "tomas": "tom", "victor": "vic", "victoria": "vicky vic tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt", "william": "bill will billy liam",
    "yusuf": "yus", "zachary": "zach", "zoe": "zo",
}

# Common Russian given names, in the nominative.
RUSSIAN_GIVEN = frozenset(
    "александр алексей андрей анна антон борис вера виктор виктория владимир галина дарья денис дмитрий евгений екатерина елена иван игорь ирина кирилл ксения "
    "лариса лев людмила максим мария михаил надежда наталья николай нина оксана олег ольга павел пётр петр полина роман светлана сергей софия степан татьяна фёдор юлия юрий яна".split()
)

# More given names, without short forms.
OTHER_GIVEN = frozenset(
    "mary jane anna jan hans karl otto pierre jean luc marie claire juan jose luis carlos pablo diego ana lucia carmen giovanni marco luca paolo giulia francesca ahmed ali omar fatima mohammed "
    "hassan aisha ravi arjun anil sunita deepa wei ming hiroshi yuki kenji akira min jun lars erik anders sven astrid piotr pawel katarzyna miguel joao pedro andre bruno chinedu amara kwame "
    "ibrahim mehmet emre ayse sean liam siobhan niamh emma olivia noah lucas ethan mia ava grace chloe lily ruby harper mason logan owen ryan kevin brian jason justin brandon tyler".split()
)

# Words before technical numbers.
TECHNICAL = frozenset("checksum hash digest trace request build commit serial batch invoice order tracking sku lot job run session part port parcel shard row md5 sha crc revision case version release firmware transaction ticket".split())

# Capitalized words that belong to organisations, places, products, calendars or sentences, not to persons.
NOT_NAMES = frozenset(
    "systems robotics foods holdings research studios works partners logistics analytics publishing instruments software labs laboratory bank university college school hospital clinic "
    "institute museum library airport station harbour harbor mills fen cross point ridge bay valley park bridge island river lake mountain city town village county district region "
    "gateway console planner indexer server toolkit suite cloud engine studio desktop database manager monitor platform service api app edition enterprise guild hub group team department "
    "office committee council ministry agency january february march april june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday the this that these those a an and but or if when while after before please dear hello hi thanks note update reminder correction actually yes no ticket order invoice policy "
    "version build release report project plan user assistant customer north south east west new old upper lower great street road lane avenue square hotel restaurant cafe market shop store".split()
)

# Titles before a name.
TITLES = frozenset("dr doctor prof professor mr mrs ms mx miss sir dame herr frau monsieur madame sr sra señor señora rev".split())

# Words for a role; a name made of such words names nobody.
ROLE_WORDS = frozenset(
    "user assistant system agent admin administrator operator manager lead leader boss chief head client customer vendor supplier landlord landlady tenant owner "
    "colleague coworker neighbour neighbor friend team staff support helpdesk teacher tutor doctor nurse contractor partner spouse wife husband mother father "
    "brother sister son daughter someone somebody nobody everyone unknown anonymous guest".split()
)
# Words that may stand before a role.
ROLE_LEADS = frozenset("my our your his her their the a an this that new old former account project team product sales tech office".split())

# Last words of names of organisations.
ORG_WORDS = frozenset("systems robotics foods holdings research studios works partners logistics analytics publishing instruments software labs bank group industries electronics motors airlines media energy".split())

# The most frequent Chinese family names of one character, and of two.
HAN_SURNAMES = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤")
HAN_COMPOUND = frozenset("欧阳 司马 上官 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐".split())

# Endings that tell a company's legal form.
LEGAL_FORMS = frozenset("ltd limited gmbh corp corporation inc incorporated co company llc plc ag sa sarl bv nv pty lp llp kg oy ab spa srl".split())


def nickname_table() -> dict[str, frozenset[str]]:
    """The full given names that a short or full form may stand for."""
    table: dict[str, set[str]] = {}
    for full, short in GIVEN_NAMES.items():
        for form in [full, *short.split()]:
            table.setdefault(form, set()).add(full)
    return {k: frozenset(v) for k, v in table.items()}
