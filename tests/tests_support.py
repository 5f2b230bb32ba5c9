import io
import zipfile

PACKAGES = "id long, supplier_id int, received_at timestamp, package_hash string, payload_type string, storage_mode string, original_filename string, canonical_package_id long, file_count int, unpack_error string"
FILES = "id long, package_id long, blob_hash string, role string, original_filename string, sequence_number int"
BLOBS = "content_hash string, size int, stored_size int, segment_id int, offset long, ref_count long, first_seen_at timestamp"
H = [f"{i:02x}" * 32 for i in range(20)]


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()
