"""Small hand-written XML documents covering the document edge cases."""

POLICY = """<?xml version="1.0" encoding="UTF-8"?>
<Session>
  <TransactionInfo><TransactionID>T-1</TransactionID><TransactionDate>2025-10-05T10:30:00</TransactionDate></TransactionInfo>
  <Data>
    <Policy><PolicyNumber> 007 </PolicyNumber><TotalPremium>1250.75</TotalPremium><EffectiveDate>2025-10-05</EffectiveDate>
      <IsActive>yes</IsActive></Policy>
    <Vehicle><VIN>1HGCM</VIN><Make>Honda</Make></Vehicle>
    <Coverages>
      <Coverage id="c1"><Code>BI</Code><Limit>100000</Limit></Coverage>
      <Coverage id="c2"><Code>PD</Code></Coverage>
      <Coverage id="c3"><Code>COLL</Code><Limit>500</Limit></Coverage>
    </Coverages>
    <Empty/>
  </Data>
</Session>"""

# default namespace, prefixed namespace, CDATA, comment, mixed content, attributes
NAMESPACED = """<?xml version="1.0"?>
<!-- leading comment -->
<Session xmlns="urn:a" xmlns:b="urn:b">
  <b:Info b:kind="x" ver="2">hello<Sub>inner</Sub>tail</b:Info>
  <Note><![CDATA[<raw> & text]]></Note>
  <!-- inner comment with vehicle word -->
  <Account id="7">acct text</Account>
</Session>"""

JUNK_PROLOG = "garbage\x00 before <?xml version=\"1.0\"?><Session><A>1</A></Session>"
TRUNCATED = "<?xml version=\"1.0\"?><Session><A>1</A><B>"
LEAF_AND_PARENT_1 = "<Session><Item>plain</Item></Session>"
LEAF_AND_PARENT_2 = "<Session><Item><Sub>x</Sub></Item></Session>"
FIRST_CHILD = "<Session><B><X>1</X></B><B><C>2</C></B></Session>"
