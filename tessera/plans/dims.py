"""Constant dimension tables of the DICOM standard, as small DataFrames that Spark broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the standard (PS3.5 table 6.2-1): code, name, text, 4-byte length in explicit encodings, padding byte, fixed size.
VR = [
    ("AE", "Application Entity", True, False, 32, None),
    ("AS", "Age String", True, False, 32, 4),
    ("AT", "Attribute Tag", False, False, 0, 4),
    ("CS", "Code String", True, False, 32, None),
    ("DA", "Date", True, False, 32, 8),
    ("DS", "Decimal String", True, False, 32, None),
    ("DT", "Date Time", True, False, 32, None),
    ("FD", "Floating Point Double", False, False, 0, 8),
    ("FL", "Floating Point Single", False, False, 0, 4),
    ("IS", "Integer String", True, False, 32, None),
    ("LO", "Long String", True, False, 32, None),
    ("LT", "Long Text", True, False, 32, None),
    ("OB", "Other Byte", False, True, 0, None),
    ("OD", "Other Double", False, True, 0, None),
    ("OF", "Other Float", False, True, 0, None),
    ("OL", "Other Long", False, True, 0, None),
    ("OV", "Other 64-bit Very Long", False, True, 0, None),
    ("OW", "Other Word", False, True, 0, None),
    ("PN", "Person Name", True, False, 32, None),
    ("SH", "Short String", True, False, 32, None),
    ("SL", "Signed Long", False, False, 0, 4),
    ("SQ", "Sequence of Items", False, True, 0, None),
    ("SS", "Signed Short", False, False, 0, 2),
    ("ST", "Short Text", True, False, 32, None),
    ("SV", "Signed 64-bit Very Long", False, True, 0, 8),
    ("TM", "Time", True, False, 32, None),
    ("UC", "Unlimited Characters", True, True, 32, None),
    ("UI", "Unique Identifier", True, False, 0, None),
    ("UL", "Unsigned Long", False, False, 0, 4),
    ("UN", "Unknown", False, True, 0, None),
    ("UR", "Universal Resource", True, True, 32, None),
    ("US", "Unsigned Short", False, False, 0, 2),
    ("UT", "Unlimited Text", True, True, 32, None),
    ("UV", "Unsigned 64-bit Very Long", False, True, 0, 8),
]

# Fixed values of the standard (PS3.6 annex A): uid, name, little endian, explicit VR, encapsulated, deflated.
TRANSFER_SYNTAX = [
    ("1.2.840.10008.1.2", "Implicit VR Little Endian", True, False, False, False),
    ("1.2.840.10008.1.2.1", "Explicit VR Little Endian", True, True, False, False),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian", False, True, False, False),
    ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian", True, True, False, True),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline (Process 1)", True, True, True, False),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended (Process 2 & 4)", True, True, True, False),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless, Non-Hierarchical (Process 14)", True, True, True, False),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless, Non-Hierarchical, First-Order Prediction (Process 14 [Selection Value 1])", True, True, True, False),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless Image Compression", True, True, True, False),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Lossy (Near-Lossless) Image Compression", True, True, True, False),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Image Compression (Lossless Only)", True, True, True, False),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000 Image Compression", True, True, True, False),
    ("1.2.840.10008.1.2.4.201", "High-Throughput JPEG 2000 Image Compression (Lossless Only)", True, True, True, False),
    ("1.2.840.10008.1.2.4.202", "High-Throughput JPEG 2000 with RPCL Options Image Compression (Lossless Only)", True, True, True, False),
    ("1.2.840.10008.1.2.4.203", "High-Throughput JPEG 2000 Image Compression", True, True, True, False),
    ("1.2.840.10008.1.2.5", "RLE Lossless", True, True, True, False),
]

# Fixed values of the standard (PS3.6 table 6-1): group, element, VR, keyword.
TAG = [
    (0x0002, 0x0000, "UL", "FileMetaInformationGroupLength"), (0x0002, 0x0001, "OB", "FileMetaInformationVersion"),
    (0x0002, 0x0002, "UI", "MediaStorageSOPClassUID"), (0x0002, 0x0003, "UI", "MediaStorageSOPInstanceUID"),
    (0x0002, 0x0010, "UI", "TransferSyntaxUID"), (0x0002, 0x0012, "UI", "ImplementationClassUID"),
    (0x0002, 0x0013, "SH", "ImplementationVersionName"), (0x0002, 0x0016, "AE", "SourceApplicationEntityTitle"),
    (0x0008, 0x0005, "CS", "SpecificCharacterSet"), (0x0008, 0x0008, "CS", "ImageType"), (0x0008, 0x0016, "UI", "SOPClassUID"),
    (0x0008, 0x0018, "UI", "SOPInstanceUID"), (0x0008, 0x0020, "DA", "StudyDate"), (0x0008, 0x0021, "DA", "SeriesDate"),
    (0x0008, 0x0022, "DA", "AcquisitionDate"), (0x0008, 0x0023, "DA", "ContentDate"), (0x0008, 0x0030, "TM", "StudyTime"),
    (0x0008, 0x0031, "TM", "SeriesTime"), (0x0008, 0x0050, "SH", "AccessionNumber"), (0x0008, 0x0052, "CS", "QueryRetrieveLevel"),
    (0x0008, 0x0060, "CS", "Modality"), (0x0008, 0x0061, "CS", "ModalitiesInStudy"), (0x0008, 0x0070, "LO", "Manufacturer"),
    (0x0008, 0x0080, "LO", "InstitutionName"), (0x0008, 0x0090, "PN", "ReferringPhysicianName"), (0x0008, 0x1030, "LO", "StudyDescription"),
    (0x0008, 0x103E, "LO", "SeriesDescription"), (0x0008, 0x1115, "SQ", "ReferencedSeriesSequence"), (0x0008, 0x1140, "SQ", "ReferencedImageSequence"),
    (0x0008, 0x1150, "UI", "ReferencedSOPClassUID"), (0x0008, 0x1155, "UI", "ReferencedSOPInstanceUID"),
    (0x0010, 0x0010, "PN", "PatientName"), (0x0010, 0x0020, "LO", "PatientID"), (0x0010, 0x0021, "LO", "IssuerOfPatientID"),
    (0x0010, 0x0030, "DA", "PatientBirthDate"), (0x0010, 0x0040, "CS", "PatientSex"), (0x0010, 0x1010, "AS", "PatientAge"),
    (0x0010, 0x1020, "DS", "PatientSize"), (0x0010, 0x1030, "DS", "PatientWeight"),
    (0x0018, 0x0050, "DS", "SliceThickness"), (0x0020, 0x000D, "UI", "StudyInstanceUID"), (0x0020, 0x000E, "UI", "SeriesInstanceUID"),
    (0x0020, 0x0010, "SH", "StudyID"), (0x0020, 0x0011, "IS", "SeriesNumber"), (0x0020, 0x0013, "IS", "InstanceNumber"),
    (0x0020, 0x1200, "IS", "NumberOfPatientRelatedStudies"), (0x0020, 0x1202, "IS", "NumberOfPatientRelatedSeries"),
    (0x0020, 0x1204, "IS", "NumberOfPatientRelatedInstances"), (0x0020, 0x1206, "IS", "NumberOfStudyRelatedSeries"),
    (0x0020, 0x1208, "IS", "NumberOfStudyRelatedInstances"), (0x0020, 0x1209, "IS", "NumberOfSeriesRelatedInstances"),
    (0x0028, 0x0002, "US", "SamplesPerPixel"), (0x0028, 0x0004, "CS", "PhotometricInterpretation"), (0x0028, 0x0006, "US", "PlanarConfiguration"),
    (0x0028, 0x0008, "IS", "NumberOfFrames"), (0x0028, 0x0010, "US", "Rows"), (0x0028, 0x0011, "US", "Columns"),
    (0x0028, 0x0100, "US", "BitsAllocated"), (0x0028, 0x0101, "US", "BitsStored"), (0x0028, 0x0102, "US", "HighBit"),
    (0x0028, 0x0103, "US", "PixelRepresentation"), (0x0028, 0x1050, "DS", "WindowCenter"), (0x0028, 0x1051, "DS", "WindowWidth"),
    (0x0028, 0x1052, "DS", "RescaleIntercept"), (0x0028, 0x1053, "DS", "RescaleSlope"), (0x7FE0, 0x0010, "OW", "PixelData"),
]

# Fixed values of the standard (PS3.6): lower and upper group and element of repeating entries, parity of the group, VR, keyword.
TAG_RANGE = [
    (0x0000, 0xFFFF, 0x0000, 0x0000, "any", "UL", "GenericGroupLength"),
    (0x6000, 0x60FF, 0x0010, 0x0010, "even", "US", "OverlayRows"), (0x6000, 0x60FF, 0x0011, 0x0011, "even", "US", "OverlayColumns"),
    (0x6000, 0x60FF, 0x0050, 0x0050, "even", "SS", "OverlayOrigin"), (0x6000, 0x60FF, 0x3000, 0x3000, "even", "OW", "OverlayData"),
    (0x5000, 0x50FF, 0x3000, 0x3000, "even", "OW", "CurveData"), (0x0009, 0xFFFF, 0x0010, 0x00FF, "odd", "LO", "PrivateCreator"),
]

# What the pixel codecs can do, by the last part of the transfer syntax UID.
DECODES = ["4.50", "4.51", "4.57", "4.70", "4.80", "4.81", "4.90", "4.91", "4.201", "4.202", "4.203", "5"]
ENCODES = ["4.50", "4.51", "4.57", "4.70", "4.80", "4.81", "4.90", "4.91", "4.201", "4.203", "5"]

# Fixed values of the standard (PS3.7 annex C): DIMSE statuses used by query and retrieve.
STATUS = {"success": 0x0000, "pending": 0xFF00, "some_failed": 0xB000, "unknown_destination": 0xA801, "no_provider": 0x0211}


# Fixed values of the standard (PS3.6 annex A): UIDs of SOP classes and their names.
UID_NAME = [
    ("1.2.840.10008.1.1", "Verification SOP Class"), ("1.2.840.10008.3.1.1.1", "DICOM Application Context Name"),
    ("1.2.840.10008.5.1.4.1.1.1", "Computed Radiography Image Storage"), ("1.2.840.10008.5.1.4.1.1.1.1", "Digital X-Ray Image Storage - For Presentation"),
    ("1.2.840.10008.5.1.4.1.1.2", "CT Image Storage"), ("1.2.840.10008.5.1.4.1.1.2.1", "Enhanced CT Image Storage"),
    ("1.2.840.10008.5.1.4.1.1.4", "MR Image Storage"), ("1.2.840.10008.5.1.4.1.1.4.1", "Enhanced MR Image Storage"),
    ("1.2.840.10008.5.1.4.1.1.6.1", "Ultrasound Image Storage"), ("1.2.840.10008.5.1.4.1.1.7", "Secondary Capture Image Storage"),
    ("1.2.840.10008.5.1.4.1.1.12.1", "X-Ray Angiographic Image Storage"), ("1.2.840.10008.5.1.4.1.1.20", "Nuclear Medicine Image Storage"),
    ("1.2.840.10008.5.1.4.1.1.88.11", "Basic Text SR Storage"), ("1.2.840.10008.5.1.4.1.1.104.1", "Encapsulated PDF Storage"),
    ("1.2.840.10008.5.1.4.1.1.128", "Positron Emission Tomography Image Storage"), ("1.2.840.10008.5.1.4.1.1.481.1", "RT Image Storage"),
    ("1.2.840.10008.5.1.4.1.2.1.1", "Patient Root Query/Retrieve Information Model - FIND"), ("1.2.840.10008.5.1.4.1.2.1.2", "Patient Root Query/Retrieve Information Model - MOVE"),
    ("1.2.840.10008.5.1.4.1.2.1.3", "Patient Root Query/Retrieve Information Model - GET"), ("1.2.840.10008.5.1.4.1.2.2.1", "Study Root Query/Retrieve Information Model - FIND"),
    ("1.2.840.10008.5.1.4.1.2.2.2", "Study Root Query/Retrieve Information Model - MOVE"), ("1.2.840.10008.5.1.4.1.2.2.3", "Study Root Query/Retrieve Information Model - GET"),
]


def dim_uid(spark: SparkSession) -> DataFrame:
    """uid and name of SOP classes and transfer syntaxes."""
    return spark.createDataFrame(UID_NAME + [(t[0], t[1]) for t in TRANSFER_SYNTAX], "uid string, name string")


def dim_vr(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VR, "vr string, name string, is_text boolean, long_length boolean, padding int, fixed_size int")


def dim_transfer_syntax(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSFER_SYNTAX, "uid string, name string, little_endian boolean, explicit_vr boolean, encapsulated boolean, deflated boolean")


def dim_tag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g * 65536 + e, vr, k) for g, e, vr, k in TAG], "tag long, vr string, keyword string")


def dim_tag_range(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(TAG_RANGE)], "entry int, group_low int, group_high int, element_low int, element_high int, parity string, vr string, keyword string")


def capabilities(spark: SparkSession, which: list[str]) -> DataFrame:
    return spark.createDataFrame([("1.2.840.10008.1.2." + s,) for s in which], "uid string")
