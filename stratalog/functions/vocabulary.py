"""Names, schemas and keys of the change log."""

from __future__ import annotations

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
META = "http://stratalog/meta#"

TYPE, PROPERTY = RDF + "type", RDF + "Property"
DOMAIN, RANGE = RDFS + "domain", RDFS + "range"
SUB_CLASS, SUB_PROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
CLASS, OBJECT_PROPERTY, DATA_PROPERTY = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty"
PROPERTY_TYPES = (PROPERTY, OBJECT_PROPERTY, DATA_PROPERTY)

#: Marker super-properties: what makes a property single, list- or map-valued.
SINGLE_LITERAL, SINGLE_OBJECT = META + "single/literal", META + "single/object"
LIST_REF, LIST_OWNER = META + "list/hasList", META + "list/containerOwnerRef"
LIST_CLASS, MEMBER = RDF + "Seq", RDF + "li"
MAP_REF, MAP_OWNER, MAP_ENTRY = META + "map/mapRef", META + "map/containerOwnerRef", META + "map/EntryType"
MAP_KEY, MAP_LITERAL, MAP_OBJECT = META + "map/key", META + "map/literalValue", META + "map/objectValue"

#: A statement is the same as another if these are, null-safely; containment is no part of it.
STATEMENT = ["subject", "predicate", "object", "datatype"]

STATEMENT_DDL = "containingsubject STRING, subject STRING, containmentpredicate STRING, predicate STRING, datatype STRING, object STRING"
COMMIT_DDL = (
    "commitId STRING, originatingBranchId STRING, commitMessage STRING, precedingCommitId STRING, timeStamp BIGINT, "
    f"addedStatements ARRAY<STRUCT<{STATEMENT_DDL}>>, removedStatements ARRAY<STRUCT<{STATEMENT_DDL}>>"
)
EVENT_DDL = "branch_id STRING, seq BIGINT, commitUUID STRING, batchId INT, totalBatches INT, body STRING"
DELIVERY_DDL = "seq BIGINT, commitId STRING, sendingBranchId STRING, receivingBranchId STRING"
#: Lexical forms of the XSD types that have typed accessors.
LEXICAL = {
    XSD + "boolean": r"^(true|false|0|1)$",
    XSD + "byte": r"^[+-]?[0-9]+$",
    XSD + "short": r"^[+-]?[0-9]+$",
    XSD + "int": r"^[+-]?[0-9]+$",
    XSD + "long": r"^[+-]?[0-9]+$",
    XSD + "nonNegativeInteger": r"^[+]?[0-9]+$",
    XSD + "float": r"^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    XSD + "double": r"^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    XSD + "string": r"(?s)^.*$",
}
#: Spark types of the typed accessors.
TYPED = {"boolean": "BOOLEAN", "byte": "TINYINT", "short": "SMALLINT", "int": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "STRING"}
