"""Declared schemas of the two table families.

``CARE`` is the facility database (residents, staff, care events, sensors);
``CLINIC`` is the older outpatient schema the analytic queries Q1-Q17 use.
Table and column names are fixed values shared with the data.

Keys are BIGINT: a 32-bit serial runs out long before the event tables reach
their target size. TIME columns are seconds of day (INT) and TIMESTAMP columns
carry no zone.
"""

CARE = {
    "rol": "id_rol BIGINT NOT NULL, nombre_rol STRING NOT NULL, nivel_acceso INT NOT NULL",
    "ala": (
        "id_ala BIGINT NOT NULL, nombre STRING NOT NULL, piso INT NOT NULL, "
        "descripcion STRING, activa BOOLEAN NOT NULL"
    ),
    "sala": (
        "id_sala BIGINT NOT NULL, nombre STRING NOT NULL, id_ala BIGINT NOT NULL, "
        "capacidad INT NOT NULL"
    ),
    "limite_jardin": (
        "id_limite BIGINT NOT NULL, descripcion STRING, lat_min DECIMAL(10,7) NOT NULL, "
        "lat_max DECIMAL(10,7) NOT NULL, lon_min DECIMAL(10,7) NOT NULL, "
        "lon_max DECIMAL(10,7) NOT NULL"
    ),
    "medicamento": (
        "id_medicamento BIGINT NOT NULL, nombre STRING NOT NULL, descripcion STRING, "
        "unidad STRING NOT NULL"
    ),
    "staff": (
        "id_staff BIGINT NOT NULL, nombre STRING NOT NULL, apellidos STRING NOT NULL, "
        "especialidad STRING NOT NULL, email STRING NOT NULL, id_rol BIGINT NOT NULL, "
        "activo BOOLEAN NOT NULL, fecha_alta DATE NOT NULL"
    ),
    "usuario_sistema": (
        "id_usuario BIGINT NOT NULL, username STRING NOT NULL, password_hash STRING NOT NULL, "
        "id_staff BIGINT NOT NULL, activo BOOLEAN NOT NULL, ultimo_login TIMESTAMP_NTZ"
    ),
    "residente": (
        "id_residente BIGINT NOT NULL, nombre STRING NOT NULL, apellidos STRING NOT NULL, "
        "fecha_nacimiento DATE NOT NULL, sexo STRING NOT NULL, habitacion STRING, "
        "diagnostico_principal STRING, nivel_movilidad STRING NOT NULL, "
        "contacto_emergencia STRING, tel_emergencia STRING, fecha_ingreso DATE NOT NULL, "
        "activo BOOLEAN NOT NULL"
    ),
    "asignacion": (
        "id_asignacion BIGINT NOT NULL, id_residente BIGINT NOT NULL, id_staff BIGINT NOT NULL, "
        "tipo_rol STRING NOT NULL, fecha_inicio DATE NOT NULL, fecha_fin DATE, "
        "es_principal BOOLEAN NOT NULL"
    ),
    "turno": (
        "id_turno BIGINT NOT NULL, id_staff BIGINT NOT NULL, id_ala BIGINT NOT NULL, "
        "fecha DATE NOT NULL, hora_inicio INT NOT NULL, hora_fin INT NOT NULL"
    ),
    "sesion_terapia": (
        "id_sesion BIGINT NOT NULL, id_residente BIGINT NOT NULL, id_terapeuta BIGINT NOT NULL, "
        "id_sala BIGINT NOT NULL, fecha_sesion TIMESTAMP_NTZ NOT NULL, "
        "tipo_sesion STRING NOT NULL, duracion_min INT NOT NULL, asistio BOOLEAN NOT NULL, "
        "notas STRING"
    ),
    "checkin_estado_animo": (
        "id_checkin BIGINT NOT NULL, id_residente BIGINT NOT NULL, id_cuidador BIGINT NOT NULL, "
        "fecha_registro TIMESTAMP_NTZ NOT NULL, puntaje INT NOT NULL, notas STRING"
    ),
    "reporte_incidente": (
        "id_incidente BIGINT NOT NULL, id_residente BIGINT NOT NULL, id_staff BIGINT NOT NULL, "
        "fecha TIMESTAMP_NTZ NOT NULL, tipo STRING NOT NULL, descripcion STRING NOT NULL, "
        "severidad STRING NOT NULL"
    ),
    "horario_medicamento": (
        "id_horario BIGINT NOT NULL, id_residente BIGINT NOT NULL, "
        "id_medicamento BIGINT NOT NULL, hora_programada INT NOT NULL, dosis STRING NOT NULL, "
        "frecuencia STRING NOT NULL, activo BOOLEAN NOT NULL"
    ),
    "log_medicamento": (
        "id_log BIGINT NOT NULL, id_horario BIGINT NOT NULL, id_cuidador BIGINT NOT NULL, "
        "fecha_administracion TIMESTAMP_NTZ NOT NULL, incidente STRING"
    ),
    "gps_ping": (
        "id_ping BIGINT NOT NULL, id_residente BIGINT NOT NULL, latitud DECIMAL(10,7) NOT NULL, "
        "longitud DECIMAL(10,7) NOT NULL, registrado_en TIMESTAMP_NTZ NOT NULL"
    ),
    "nfc_tag": (
        "id_tag BIGINT NOT NULL, codigo_tag STRING NOT NULL, id_residente BIGINT NOT NULL, "
        "descripcion STRING"
    ),
    "nfc_evento": (
        "id_evento BIGINT NOT NULL, id_tag BIGINT NOT NULL, id_staff BIGINT NOT NULL, "
        "escaneado_en TIMESTAMP_NTZ NOT NULL, id_log_med BIGINT"
    ),
    "lector_rfid": (
        "id_lector BIGINT NOT NULL, ubicacion STRING NOT NULL, es_restringido BOOLEAN NOT NULL, "
        "id_ala BIGINT, id_sala BIGINT"
    ),
    "acceso_rfid": (
        "id_acceso BIGINT NOT NULL, id_lector BIGINT NOT NULL, id_staff BIGINT NOT NULL, "
        "accedido_en TIMESTAMP_NTZ NOT NULL, acceso_concedido BOOLEAN NOT NULL"
    ),
    "beacon": "id_beacon BIGINT NOT NULL, id_ala BIGINT NOT NULL, nombre STRING NOT NULL",
    "deteccion_beacon": (
        "id_deteccion BIGINT NOT NULL, id_beacon BIGINT NOT NULL, id_staff BIGINT NOT NULL, "
        "detectado_en TIMESTAMP_NTZ NOT NULL"
    ),
    "log_auditoria": (
        "id_log BIGINT NOT NULL, id_usuario BIGINT NOT NULL, tabla_afectada STRING NOT NULL, "
        "operacion STRING NOT NULL, id_registro BIGINT, ip_origen STRING, "
        "timestamp_operacion TIMESTAMP_NTZ NOT NULL"
    ),
}

CLINIC = {
    "paciente": (
        "id_paciente BIGINT NOT NULL, nombre STRING, apellidos STRING, "
        "diagnostico_principal STRING, id_cuidador BIGINT, fecha_registro TIMESTAMP_NTZ"
    ),
    "sesion_psicologica": (
        "id_sesion BIGINT NOT NULL, id_paciente BIGINT NOT NULL, id_profesional BIGINT NOT NULL, "
        "fecha_sesion TIMESTAMP_NTZ NOT NULL, duracion_min INT, estado_emoc_inicio INT, "
        "estado_emoc_fin INT"
    ),
    "aplicacion_escala": (
        "id_aplicacion BIGINT NOT NULL, id_paciente BIGINT NOT NULL, id_profesional BIGINT, "
        "id_sesion BIGINT, id_escala STRING NOT NULL, fecha_aplicacion TIMESTAMP_NTZ NOT NULL, "
        "puntaje_total INT, nivel_riesgo STRING"
    ),
    "escala_clinica": "id_escala STRING NOT NULL, nombre_escala STRING, tipo STRING",
    "alerta_riesgo": (
        "id_alerta BIGINT NOT NULL, id_paciente BIGINT NOT NULL, id_aplicacion BIGINT, "
        "id_prof_atiende BIGINT, tipo_alerta STRING, nivel_severidad STRING, "
        "descripcion STRING, estado_alerta STRING, fecha_generacion TIMESTAMP_NTZ NOT NULL, "
        "fecha_resolucion TIMESTAMP_NTZ"
    ),
    "profesional": (
        "id_profesional BIGINT NOT NULL, nombre STRING, apellidos STRING, especialidad STRING, "
        "id_rol BIGINT, activo BOOLEAN"
    ),
    "rol": "id_rol BIGINT NOT NULL, nombre_rol STRING",
    "cuidador": "id_cuidador BIGINT NOT NULL, nombre STRING, apellidos STRING, telefono STRING",
    "evento_gps": (
        "id_dispositivo BIGINT, id_paciente BIGINT NOT NULL, latitud DECIMAL(10,7), "
        "longitud DECIMAL(10,7), timestamp_evento TIMESTAMP_NTZ NOT NULL, "
        "dentro_zona_segura BOOLEAN"
    ),
    "dispositivo_iot": (
        "id_dispositivo BIGINT NOT NULL, tipo_dispositivo STRING, identificador_hw STRING, "
        "estado STRING, id_paciente BIGINT, ultima_conexion TIMESTAMP_NTZ"
    ),
    "evento_nfc": (
        "id_paciente BIGINT NOT NULL, id_zona BIGINT NOT NULL, "
        "timestamp_evento TIMESTAMP_NTZ NOT NULL, tipo_evento STRING"
    ),
    "zona": "id_zona BIGINT NOT NULL, nombre_zona STRING",
    "evento_beacon": "id_paciente BIGINT NOT NULL, timestamp_evento TIMESTAMP_NTZ NOT NULL",
    "log_auditoria": (
        "id_usuario BIGINT NOT NULL, operacion STRING, tabla_afectada STRING, "
        "timestamp_operacion TIMESTAMP_NTZ, ip_origen STRING"
    ),
}

# Event-time column of each sensor feed and event table.
EVENT_TIME = {
    "sesion_terapia": "fecha_sesion",
    "checkin_estado_animo": "fecha_registro",
    "reporte_incidente": "fecha",
    "log_medicamento": "fecha_administracion",
    "gps_ping": "registrado_en",
    "nfc_evento": "escaneado_en",
    "acceso_rfid": "accedido_en",
    "deteccion_beacon": "detectado_en",
    "log_auditoria": "timestamp_operacion",
    "evento_gps": "timestamp_evento",
    "evento_nfc": "timestamp_evento",
    "evento_beacon": "timestamp_evento",
}
